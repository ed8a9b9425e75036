"""Quality classifier: a sparse ensemble of rules.

Small regression trees are grown on residuals over text statistics; every path from a root is a conjunctive rule. A lasso logistic
regression weighs the rules, and those that keep a weight are compiled into one Spark column expression.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_texts, pick, with_texts

#: The most labelled rows that a fit takes, by the order of a hash of their ids; they are the only rows that come to the driver.
MAX_TRAIN = 20_000
TREES, DEPTH, BINS, SHRINK, LASSO, STEPS = 24, 3, 32, 0.3, 1e-3, 300
THRESHOLD = 0.7

_UPPER, _LOWER, _DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
_STOPS, _SYMBOLS = b".,;:?!", b"#$%&*+/<=>@[\\]^_`{|}~"
STATISTICS = ("log_bytes", "log_words", "word_bytes", "upper", "lower", "beyond_ascii", "digits", "stops", "symbols", "exclaims", "bars", "lines", "distinct_words", "top_word", "distinct_lines", "symbol_words", "longest_word")


def statistics(text: str | None) -> tuple[float, ...]:
    """Statistics of a whole text; an empty one has zeros."""
    b = (text or "").encode()
    n = len(b)
    if not n:
        return (0.0,) * len(STATISTICS)
    share = lambda chars: (n - len(b.translate(None, chars))) / n
    words = b.split()
    m = len(words) or 1
    distinct = set(words)
    lines = [x for x in b.split(b"\n") if x]
    low = b.lower()
    counts: dict[bytes, int] = {}
    for w in low.split():
        counts[w] = counts.get(w, 0) + 1
    ascii_ = len(b.translate(None, bytes(range(128, 256))))
    marked = b.translate(bytes(1 if c in _SYMBOLS else 2 if c in b" \t\n\r\x0b\x0c" else 0 for c in range(256)))
    return (
        float(np.log1p(n)), float(np.log1p(len(words))), n / m, share(_UPPER), share(_LOWER), 1 - ascii_ / n, share(_DIGIT), share(_STOPS), share(_SYMBOLS), b.count(b"!") / m, b.count(b"|") / m,
        len(lines) / m, len(distinct) / m, max(counts.values(), default=0) / m, len(set(lines)) / (len(lines) or 1), (marked.count(b"\x01\x02") + marked.endswith(b"\x01")) / m, float(np.log1p(max(map(len, words), default=0))),
    )


FIELDS = [(s, "double", pa.float64()) for s in STATISTICS]


def _columns(texts: list) -> list[list]:
    return [list(c) for c in zip(*map(statistics, texts))] if texts else [[] for _ in STATISTICS]


def with_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return map_texts(docs, key, text, FIELDS, _columns)


#: A rule: (statistic, whether above, threshold) for each of its conditions.
Rule = tuple[tuple[int, bool, float], ...]


@dataclass(frozen=True)
class RuleModel:
    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self) -> Column:
        """The score as one column expression over the statistics."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            test = None
            for j, above, cut in rule:
                c = F.col(STATISTICS[j]) > F.lit(cut) if above else F.col(STATISTICS[j]) <= F.lit(cut)
                test = c if test is None else test & c
            total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for rule, weight in self.rules:
            z = z + weight * held(rule, x)
        return 1.0 / (1.0 + np.exp(-z))


def held(rule: Rule, x: np.ndarray) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for j, above, cut in rule:
        ok &= (x[:, j] > cut) == above
    return ok


def _paths(x: np.ndarray, codes: np.ndarray, cuts: list[np.ndarray], residual: np.ndarray, rows: np.ndarray, rule: Rule, depth: int, fit: np.ndarray) -> list[Rule]:
    """Grows a tree below a rule by least squares; sets fit to the leaves' means; returns the rules of all its nodes."""
    r = residual[rows]
    fit[rows] = r.mean()
    if depth == 0 or len(rows) < 40:
        return []
    best = (1e-9, -1, 0)
    for j, c in enumerate(cuts):
        if not len(c):
            continue
        n = np.bincount(codes[rows, j], minlength=len(c) + 1).cumsum()[:-1]
        s = np.bincount(codes[rows, j], weights=r, minlength=len(c) + 1).cumsum()[:-1]
        ok = (n >= 10) & (len(rows) - n >= 10)
        if ok.any():
            gain = np.where(ok, s**2 / np.maximum(n, 1) + (r.sum() - s) ** 2 / np.maximum(len(rows) - n, 1), -1) - r.sum() ** 2 / len(rows)
            k = int(gain.argmax())
            if gain[k] > best[0] + 1e-12:
                best = (float(gain[k]), j, k)
    _, j, k = best
    if j < 0:
        return []
    out = []
    for above in (False, True):
        sub = rows[(codes[rows, j] > k) == above]
        longer = (*rule, (j, above, float(cuts[j][k])))
        out += [longer, *_paths(x, codes, cuts, residual, sub, longer, depth - 1, fit)]
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO, seed: int = 7) -> RuleModel:
    """Rules from boosted trees on halves of the rows, weighed by lasso logistic regression (accelerated proximal gradient)."""
    n = len(y)
    rate = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if n else 0.5
    bias = float(np.log(rate / (1 - rate)))
    if n < 50 or len(np.unique(y)) < 2:
        return RuleModel(bias, ())
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    cuts = [c[c < x[:, j].max()] for j, c in enumerate(cuts)]
    codes = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    rng, z, rules = np.random.default_rng(seed), np.full(n, bias), {}
    for _ in range(trees):
        rows = np.sort(rng.choice(n, max(50, n // 2), replace=False)) if n >= 100 else np.arange(n)
        residual, fit = y - _sigmoid(z), np.zeros(n)
        found = _paths(x, codes, cuts, residual, rows, (), depth, fit)
        # rows out of the half get the leaf that they fall into
        for rule in found:
            ok = held(rule, x)
            inside = rows[ok[rows]]
            if len(inside):
                fit[ok] = residual[inside].mean()
            rules.setdefault(rule)
        z += SHRINK * 4 * fit
    names = list(rules)
    a = np.stack([held(r, x) for r in names], axis=1).astype(np.float64)
    use = (a.mean(0) > 0.002) & (a.mean(0) < 0.998)
    names, a = [r for r, u in zip(names, use) if u], a[:, use]
    a, first = np.unique(a, axis=1, return_index=True)
    names = [names[i] for i in first]
    scale = a.std(0)
    mean = a.mean(0)
    s = (a - mean) / scale
    w, b, v, vb, t = np.zeros(len(names)), bias, np.zeros(len(names)), bias, 1.0
    step = 4.0 / max(np.linalg.eigvalsh(s.T @ s / n)[-1] + 1, 1e-9)
    for _ in range(STEPS):
        g = (_sigmoid(s @ v + vb) - y) / n
        w2 = v - step * (s.T @ g)
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * lasso, 0)
        b2 = vb - step * g.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    weights = w / scale
    return RuleModel(float(b - (weights * mean).sum()), tuple((r, float(k)) for r, k in zip(names, weights) if k != 0.0))


def held_out(key: Column) -> Column:
    """Rows whose labels are never learned: crc32 of the id's text leaves 2 when divided by 4. A null id counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_train: int = MAX_TRAIN) -> RuleModel:
    """Fits the rules on at most max_train labelled rows that are not held out. Labels other than 0 and 1 are left out."""
    marked = pick(labels, key, label).where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(key).agg(F.max(label).alias("_label"))
    sample = marked.orderBy(F.xxhash64(key), key).limit(max_train)
    known = pick(docs, key, text).join(F.broadcast(sample), key).select(key, text)  # max_train rows at most
    got = with_statistics(known, key, text).join(F.broadcast(sample), key).orderBy(F.xxhash64(key), key, *STATISTICS).limit(max_train).toPandas()
    return fit_rules(got[list(STATISTICS)].to_numpy(np.float64).reshape(-1, len(STATISTICS)), got["_label"].to_numpy(np.float64))


def score_quality(docs: DataFrame, model: RuleModel, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, held_out, score and predicted for every row, by the text alone.

    Null and empty texts have statistics of 0 and are scored like others; rows with null or repeated keys stay; an empty table gives no
    rows. Without two classes of labels, every score is the labels' mean.
    """
    scored = with_statistics(docs, key, text).select(key, held_out(F.col(key)).alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: RuleModel, columns: Sequence[str], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with these columns, that the model accepts. A row is judged where it is read: only its text goes to Python, only
    statistics come back, and nothing is joined. Rows with null texts are judged like empty ones and stay null; repeated rows are judged
    alike. A model that was fitted without two classes of labels can't reject anything: every row stays.
    """
    rows = pick(docs, *columns)
    if not model.rules:
        return rows
    inner = rows.toDF(*[f"_c{i}" for i in range(len(columns))])
    judged = with_texts(inner, f"_c{list(columns).index(text)}", FIELDS, _columns).where(model.column() >= threshold)
    return judged.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(columns)])
