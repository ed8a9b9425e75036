"""Personal data in whole texts, by DataFrame functions alone.

Base kinds are matched by possessive patterns that take linear time. They seed a bootstrap, and so do long runs of hexadecimal digits: every
token with a digit or an at sign is an instance, and its contexts are lexical patterns: the label and mark before it (`phone:`, `key =`),
the two words before it, the two words after it. Patterns are scored by the share of their instances, over all their places in the corpus,
that are known identifiers; instances by the patterns that extract them; after ROUNDS rounds the confident patterns mark identifiers of
forms that no base kind has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, discard, pick

#: The kinds in the order of the contract; `id` is what confident patterns discover.
KINDS = ("email", "ip", "card", "phone", "id")
#: The contract's patterns without backtracking. A start inside a run of the first class would end as one at the run's start does, so it
#: is skipped; \G allows the one place where the rest of a run is new: the end of the match before.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\.|$)){4}$"
#: The rest of a token: up to the last letter or digit of a run of its characters.
REST = r"(?:[._%+@/-]*+[A-Za-z0-9]++)*+"
#: A token, or a row of groups of digits, that has a digit or an at sign; it ends where its (last) token ends.
INSTANCE = r"(?<![A-Za-z0-9._%+@/-])(?:[+(]?[0-9][0-9() .-]{3,}[0-9]" + REST + r"|(?=[A-Za-z._%+/-]*+[0-9@])[A-Za-z0-9]" + REST + ")"
#: What stands before an instance or after it: a label and its mark, or two words.
LABEL, BEFORE, AFTER = r"([\p{L}_]{2,24}) ?([:=#]) ?[\"'(\[]?$", r"([\p{L}_]{1,24}) ([\p{L}_]{1,24}) [\"'(\[]?$", r"^[\"')\]]?[,;]? ([\p{L}_]{1,24}) ([\p{L}_]{1,24})(?![\p{L}_])"
NEAR = 54  # characters of context that are looked at
#: Seeds of no base kind: keys, tokens and digests in hexadecimal digits.
HEX = r"^(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{32,128}$"
ROUNDS, MIN_SEEDS, MIN_CONFIDENCE = 3, 5, 0.8
_INTS = "cast(array() as array<int>)"


def running(df: DataFrame, values: str, name: str, step: str) -> DataFrame:
    """Adds an array: for each place of an array of integers, what `step` (SQL over x and y) makes of 0 and all values before it.

    A fold that appends copies its array each time. Here it is taken block by block, with as many blocks as values in a block, so k values
    take k ** 1.5 short steps rather than k ** 2.
    """
    fold = lambda start, over: f"aggregate({over}, named_struct('x', {start}, 'out', {_INTS}), (acc, y) -> named_struct('x', {step.replace('x', 'acc.x')}, 'out', concat(acc.out, array(acc.x))), acc -> acc.out)"
    some = f"size({values}) > 0"
    df = df.withColumn("_n", F.expr(f"cast(ceil(sqrt(size({values}))) as int)"))
    df = df.withColumn("_blocks", F.expr(f"if({some}, transform(sequence(0, cast((size({values}) - 1) div _n as int)), j -> slice({values}, j * _n + 1, _n)), cast(array() as array<array<int>>))"))
    df = df.withColumn("_heads", F.expr(fold("0", f"transform(_blocks, b -> aggregate(b, 0, (x, y) -> {step}))")))
    return df.withColumn(name, F.expr(f"flatten(transform(_blocks, (b, j) -> {fold('_heads[j]', 'b')}))")).drop("_n", "_blocks", "_heads")


def _matches(text: str, pattern: str, name: str, df: DataFrame, context: int = 0) -> DataFrame:
    """Adds an array of (s, e, v) and, if asked for, context (l, r): start, end and text of every match, in code points, and what is around it."""
    found = df.withColumn("_m", F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
    found = found.withColumn("_p", F.when(F.size("_m") > 0, F.split(F.col(text), pattern, -1)).otherwise(F.array(F.lit(""))))
    found = found.withColumn("_g", F.expr("zip_with(slice(_p, 1, size(_m)), _m, (p, m) -> length(p) + length(m))"))
    found = running(found, "_g", "_a", "x + y")
    around = f", 'l', right(_p[i], {context}), 'r', left(_p[i + 1], {context})" if context else ""
    return found.withColumn(name, F.expr(f"transform(_m, (m, i) -> named_struct('s', _a[i] + length(_p[i]), 'e', _a[i] + _g[i], 'v', m{around}))")).drop("_m", "_p", "_g", "_a")


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    """Every second digit from the right counts double, less 9 beyond 9; the sum is a multiple of 10."""
    doubled = F.transform(F.split(F.reverse(_digits(v)), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(F.filter(doubled, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 10 == 0


def _with_rank(r: int) -> Callable[[Column], Column]:
    return lambda x: F.struct(x["s"].alias("s"), F.lit(r).alias("r"), x["e"].alias("e"), x["v"].alias("v"))


def _of_rank(r: int) -> Callable[[Column], Column]:
    return lambda x: x["r"] == r


def base_spans(docs: DataFrame, text: str) -> DataFrame:
    """docs with `_base`: (s, r, e, v) of every valid match, r the kind's rank, by start and then rank. The text must not be null."""
    df = docs
    for name, pattern in (("_email", EMAIL), ("_ip", IP), ("_card", CARD), ("_phone", PHONE)):
        df = _matches(text, pattern, name, df)
    valid = {
        "_email": lambda x: F.lit(True),
        "_ip": lambda x: F.rlike(x["v"], F.lit(OCTETS)),
        "_card": lambda x: _luhn(x["v"]),
        "_phone": lambda x: F.length(_digits(x["v"])).between(9, 15),
    }
    ranked = [F.transform(F.filter(c, valid[c]), _with_rank(r)) for r, c in enumerate(valid)]
    return df.withColumn("_base", F.array_sort(F.concat(*ranked))).drop(*valid)


def instances(docs: DataFrame, text: str) -> DataFrame:
    """One row for each context of each instance: the columns of docs, pattern, value, its start s and end e.

    A pattern is a kind (`label`, `before`, `after`) and the words, in lower case, with single spaces.
    """
    # explode() would have Spark evaluate the array once more in a filter of its own
    rows = _matches(text, INSTANCE, "_l", docs, NEAR).withColumn("_x", F.explode_outer("_l")).drop("_l").where("_x is not null")
    around = rows.withColumn("_b", F.lower(F.regexp_replace("_x.l", r"\s+", " "))).withColumn("_f", F.lower(F.regexp_replace("_x.r", r"\s+", " ")))
    patterns = [F.when(F.rlike(c, F.lit(rx)), F.concat(F.lit(k), F.lit(" "), F.regexp_extract(c, rx, 1), F.lit(" "), F.regexp_extract(c, rx, 2))) for k, c, rx in (("label", F.col("_b"), LABEL), ("before", F.col("_b"), BEFORE), ("after", F.col("_f"), AFTER))]
    placed = around.withColumn("pattern", F.explode_outer(F.filter(F.array(*patterns), lambda p: p.isNotNull()))).where("pattern is not null")
    return placed.select(*docs.columns, "pattern", F.col("_x.v").alias("value"), F.col("_x.s").alias("s"), F.col("_x.e").alias("e"))


def _identifier_like(value: Column) -> Column:
    return (F.length(_digits(value)) >= 5) | F.contains(value, F.lit("@"))


def _some(text: str) -> Column:
    """Whether the text can hold a match of any kind."""
    return F.rlike(F.col(text), F.lit("[0-9@]"))


def confident_patterns(docs: DataFrame, text: str, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """The patterns that the bootstrap trusts. A pattern and a value count once for each different text that has them together."""
    found = instances(base_spans(docs.select(text).where(_some(text)), text), text)
    seed = F.exists("_base", lambda b: (b["s"] < F.col("e")) & (b["e"] > F.col("s"))) | F.rlike("value", F.lit(HEX))
    places = found.select("pattern", F.when(_identifier_like(F.col("value")) | seed, F.col("value")).alias("value"), seed.cast("double").alias("seed"), F.xxhash64(text).alias("t")).distinct()
    edges = cut(places.groupBy("pattern", "value").agg(F.max("seed").alias("seed"), F.count("*").alias("n")), "edges")
    # a pattern with fewer values than seeds are asked for never gets confident
    wide = edges.where("value is not null").groupBy("pattern").agg(F.count("*").alias("c")).where(F.col("c") >= min_seeds).select("pattern")
    edges, every = cut(edges.join(wide, "pattern"), "edges"), edges
    discard(every)
    scored, patterns = edges.withColumn("score", F.col("seed")), None
    for k in range(rounds):
        found = scored.groupBy("pattern").agg((F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("confidence"), F.sum((F.col("score") >= 0.5).cast("bigint")).alias("known"))
        patterns, last = cut(found.where((F.col("known") >= min_seeds) & (F.col("confidence") >= min_confidence / 2)), "patterns"), patterns
        if last is not None:
            discard(last, scored)
        if k + 1 < rounds:
            doubt = F.log(F.lit(1.0) - F.least("confidence", F.lit(0.99)))
            belief = edges.where("value is not null").join(patterns, "pattern").groupBy("value").agg((F.lit(1.0) - F.exp(F.sum(doubt))).alias("belief"))
            known = edges.where("value is not null").join(belief, "value", "left").withColumn("score", F.greatest("seed", F.coalesce("belief", F.lit(0.0)))).drop("belief")
            scored = cut(known.unionByName(edges.where("value is null").withColumn("score", F.lit(0.0))), "scored")
    trusted = cut(patterns.where(F.col("confidence") >= min_confidence).select("pattern"), "confident")
    discard(edges, patterns)
    return trusted


def find_spans(docs: DataFrame, text: str) -> DataFrame:
    """docs with `_base` and `_all`: base spans, and with them those that confident patterns discover and no base span covers whole. The text must not be null.

    What is discovered in a text holds for all its copies; they find it by the SHA-256 of the text. Texts without a digit or an at sign
    have no spans and are not moved.
    """
    patterns = confident_patterns(docs, text)
    new = instances(docs.select(text).where(_some(text)), text).where(_identifier_like(F.col("value")) | F.rlike("value", F.lit(HEX))).join(patterns, "pattern")
    new = new.select(F.sha2(text, 256).alias("_t"), F.struct("s", F.lit(len(KINDS) - 1).alias("r"), "e", F.col("value").alias("v")).alias("x"))
    more = cut(new.groupBy("_t").agg(F.collect_set("x").alias("_more")), "discovered")
    joined = base_spans(docs.where(_some(text)), text).withColumn("_t", F.sha2(text, 256)).join(more, "_t", "left")
    none = F.expr("cast(array() as array<struct<s:int,r:int,e:int,v:string>>)")
    fresh = F.filter(F.coalesce("_more", none), lambda x: ~F.exists("_base", lambda b: (b["s"] <= x["s"]) & (b["e"] >= x["e"])))
    some = joined.withColumn("_all", F.array_sort(F.concat("_base", fresh))).drop("_more", "_t")
    return some.unionByName(docs.where(~_some(text)).withColumn("_base", none).withColumn("_all", none))


def _written(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["r"] + 1), x["s"], x["e"])), ",")


def pii_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, counts by kind, the digest of the base spans, all spans as text, and as an array of (kind, start, end).

    Null and empty texts have no spans. Null and repeated keys stay rows of their own; an empty table gives no rows.
    """
    rows = pick(docs, key, text).select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    df = find_spans(rows, "_text")
    counts = [F.size(F.filter("_base", _of_rank(r))).cast("bigint").alias(f"n_{k}") for r, k in enumerate(KINDS[:4])]
    return df.select(key, *counts, F.sha2(_written("_base").cast("binary"), 256).alias("base_sha256"), _written("_all").alias("spans"))


def redact(docs: DataFrame, columns: list[str], text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The rows of docs with every span replaced by its kind in brackets; overlapping spans are one. Null texts stay null.

    Texts without spans, null and empty ones too, stay as they are; repeated rows and rows with null keys are treated alike and stay; an
    empty table gives no rows. `n_chars` is the new text's length.
    """
    inner = [f"_c{i}" for i in range(len(columns))]
    at, size = inner[list(columns).index(text)], inner[list(columns).index(n_chars)]
    rows = pick(docs, *columns).toDF(*inner).withColumn("_text", F.coalesce(F.col(at), F.lit("")))
    kind = dict(rows.dtypes)[size]
    df = find_spans(rows, "_text")
    names = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    # where the text goes on after the spans before each span; the text is cut block by block, for finding a place takes time with its distance
    df = running(df.withColumn("_ends", F.expr("transform(_all, x -> x.e)")), "_ends", "_from", "greatest(x, y)")
    df = df.withColumn("_n", F.expr("cast(ceil(sqrt(size(_all))) as int)")).withColumn("_last", F.expr("coalesce(array_max(_ends), 0)"))
    df = df.withColumn("_parts", F.expr("if(size(_all) > 0, transform(sequence(0, cast((size(_all) - 1) div _n as int)), j -> substring(_text, _from[j * _n] + 1, if((j + 1) * _n < size(_all), _from[(j + 1) * _n], _last) - _from[j * _n])), cast(array() as array<string>))"))
    piece = f"""if(_all[i].s >= _from[i], concat(substring(_parts[j], _from[i] - _from[j * _n] + 1, _all[i].s - _from[i]), {names}[_all[i].r]), '')"""
    clean = f"""concat(array_join(transform(_parts, (p, j) -> array_join(transform(sequence(j * _n, least((j + 1) * _n, size(_all)) - 1), i -> {piece}), '')), ''), substring(_text, _last + 1))"""
    df = df.withColumn(at, F.when(F.col(at).isNotNull(), F.when(F.size("_all") > 0, F.expr(clean)).otherwise(F.col("_text"))))
    return df.withColumn(size, F.length(at).cast(kind)).select(*[F.col(i).alias(c) for i, c in zip(inner, columns)])
