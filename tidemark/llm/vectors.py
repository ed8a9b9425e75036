"""Near-duplicate vectors by sorted projection passes.

In each pass the vectors are sorted by a concatenation of random hashes (signs of random projections), and each is compared with the WINDOW
next ones; pairs that reach the cosine are links, and the links of all passes are united. The number of passes follows the number of
vectors, so that a pair at the threshold is met with probability RECALL or more, at any size, where vectors lie evenly. Tasks hold
contiguous ranges of the order; the ends of neighbouring ranges are compared in a second, small step. Equal vectors are one class from the
start. Then, unless told not to, all vectors are compared, block against block, for links between components that are still apart: dense
parts, whose windows fill with neighbours that are not close enough, have no such guarantee. A vector's number of links is counted exactly
within its component in the same manner.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, discard, pick
from tidemark.llm.graph import components

COSINE, RECALL, WINDOW, BITS, BLOCK, SEED = 0.95, 0.999, 32, 48, 256, 20240501
#: The comparison of all rows with all: blocks at least, and rows of a block at most (about, for they are dealt by hash).
SIDES, ROWS = 12, 32768


def passes_for(rows: int, window: int = WINDOW, cosine: float = COSINE, recall: float = RECALL) -> int:
    """How many passes meet a pair at this cosine with this probability, among so many vectors that lie evenly.

    Vectors that share their first log2(rows / window) hash bits lie in a window; a bit is shared with probability 1 - angle / pi. The
    number grows with about the seventh root of the rows: 13 for 10 thousand, 31 for a million, 95 for a billion.
    """
    bits = max(0.0, math.log2(max(rows, 1) / window))
    met = (1 - math.acos(min(1.0, cosine)) / math.pi) ** bits
    return 1 if met >= recall else math.ceil(math.log(1 - recall) / math.log(1 - met))


def planes(dim: int, passes: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, passes * bits))


def keyed(reps: DataFrame, passes: int, bits: int, seed: int) -> DataFrame:
    """(id, unit vector as bytes of doubles, dim, keys: one long for each pass)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, np.ndarray] = {}
        weights = (1 << np.arange(bits - 1, -1, -1)).astype(np.int64)
        for b in gathered(batches):
            col = b.column(1)
            dims = np.asarray(col.value_lengths())
            start = np.asarray(col.offsets)
            flat = np.asarray(col.values, dtype=np.float64)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                x = flat[(start[at][:, None] + np.arange(d))]
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                if d not in drawn:
                    drawn[d] = planes(d, passes, bits, seed)
                keys = ((x @ drawn[d]) >= 0).reshape(len(at), passes, bits) @ weights
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at)), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(np.full(len(at), d), pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * passes, pa.int32()), pa.array(keys.ravel(), pa.int64()))],
                    names=["id", "unit", "dim", "keys"],
                )

    return reps.select("id", "embedding").mapInArrow(run, "id bigint, unit binary, dim bigint, keys array<bigint>")


def _links(groups: np.ndarray, ids: np.ndarray, units: list[bytes], window: int, cosine: float, from_row: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows at most `window` apart, in the same group (pass and dimension), that reach the cosine; the later row is from_row or beyond."""
    a, b = [], []
    stops = [*(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(groups)]
    lo = 0
    for hi in stops:
        x = np.frombuffer(b"".join(units[lo:hi]), np.float64).reshape(hi - lo, -1)
        for s in range(0, hi - lo, 512):
            e = min(hi - lo, s + 512 + window)
            dots = x[s : min(s + 512, hi - lo)] @ x[s:e].T
            i, j = np.nonzero(dots >= cosine)
            ok = (j > i) & (j - i <= window) & (j + s + lo >= from_row)
            a.append(ids[lo + s + i[ok]])
            b.append(ids[lo + s + j[ok]])
        lo = hi
    return _forest(np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64),) * 2


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As many of the pairs as tie the same rows together: links are counted later, so that here only components matter."""
    up: dict[int, int] = {}
    keep = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        while (p := up.get(y, y)) != y:
            up[y] = up.get(p, p)
            y = p
        if x != y:
            up[max(x, y)] = min(x, y)
            keep.append(k)
    return a[keep], b[keep]


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Small batches joined to such of about so many rows, for steps that pay for each batch."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def windowed(sorted_rows: DataFrame, window: int, cosine: float) -> DataFrame:
    """Links within each task's range, and its first and last rows: kind 0 has (a, b), kind 1 a last row, kind 2 a first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        names = ["kind", "edge", "a", "b", "at", "unit"]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

        def batch(*cols: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        def ends(kind: int, g: np.ndarray, ids: np.ndarray, units: list[bytes], at: int = 0) -> pa.RecordBatch:
            return batch([kind] * len(ids), [part + (kind == 1)] * len(ids), ids, g, range(at, at + len(ids)), units)

        kept_g, kept_i, kept_u = np.empty(0, np.int64), np.empty(0, np.int64), []
        head = 0
        for b in gathered(batches):
            g = np.concatenate([kept_g, np.asarray(b.column(0))])
            ids = np.concatenate([kept_i, np.asarray(b.column(1))])
            units = kept_u + b.column(2).to_pylist()
            if head < window and len(ids) > len(kept_i):
                new = slice(len(kept_i), len(kept_i) + window - head)
                yield ends(2, g[new], ids[new], units[new], head)
                head += len(ids[new])
            x, y = _links(g, ids, units, window, cosine, len(kept_i))
            if len(x):
                yield batch([0] * len(x), [0] * len(x), x, y, [0] * len(x), [None] * len(x))
            kept_g, kept_i, kept_u = g[-window:], ids[-window:], units[-window:]
        if len(kept_i):
            yield ends(1, kept_g, kept_i, kept_u)

    return sorted_rows.select("group", "id", "unit").mapInArrow(run, "kind int, edge bigint, a bigint, b bigint, at bigint, unit binary")


def across(ends: DataFrame, window: int, cosine: float) -> DataFrame:
    """Links between the last rows of a range and the first rows of the next: 2 * window rows at a time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["kind", "at"], kind="stable")
        tail = int((pdf["kind"] == 1).sum())
        if not 0 < tail < len(pdf):
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        x, y = _links(pdf["b"].to_numpy(), pdf["a"].to_numpy(), pdf["unit"].tolist(), window, cosine, tail)
        return pd.DataFrame({"a": x, "b": y})

    return ends.where("kind > 0").groupBy("edge").applyInPandas(run, "a bigint, b bigint")


def missed(rows: DataFrame, cosine: float, sides: int) -> DataFrame:
    """Pairs of components (a, b) that a link ties and that are still apart; rows: id, component, dim, unit, dealt to `sides` blocks.

    Every two blocks meet once, whatever the rows' places in the passes. This takes time with the square of the rows: it is the price of
    certainty, for a cosine in many dimensions has no exact index.
    """
    dealt = rows.withColumn("i", F.pmod(F.xxhash64("id"), F.lit(sides))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(sides - 1).cast("bigint"))))
    dealt = dealt.select(F.least("i", "j").alias("bi"), F.greatest("i", "j").alias("bj"), "i", "component", "dim", "unit")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        bi, bj = int(pdf["bi"].iloc[0]), int(pdf["bj"].iloc[0])
        for _, part in pdf.groupby("dim", sort=False):
            x = np.frombuffer(b"".join(part["unit"]), np.float64).reshape(len(part), -1)
            i, comp = part["i"].to_numpy(), part["component"].to_numpy()
            x, cx, y, cy = x[i == bi], comp[i == bi], x[i == bj].T, comp[i == bj]
            for s in range(0, len(x), 256):
                near = x[s : s + 256] @ y >= cosine
                hit = np.flatnonzero(near.any(axis=1))
                u, v = np.nonzero(near[hit] & (cx[s + hit, None] != cy[None, :]))
                ends = np.unique(np.stack([cx[s + hit[u]], cy[v]]), axis=1)
                a.append(ends.min(axis=0))
                b.append(ends.max(axis=0))
        x, y = _forest(np.concatenate(a), np.concatenate(b))
        return pd.DataFrame({"a": x, "b": y})

    return dealt.groupBy("bi", "bj").applyInPandas(run, "a bigint, b bigint").distinct()


def link_counts(members: DataFrame, cosine: float, block: int, partitions: int) -> DataFrame:
    """(id, links): copies of all other classes of the component that reach the cosine; members: id, component, copies, dim, unit.

    A component's vectors are dealt to blocks of about `block`, or eight times the root of its size where that is more; every two blocks
    meet once. Small components share a task's groups.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    most = F.least(F.greatest(F.lit(float(block)), 8 * F.sqrt("size")), F.lit(float(ROWS)))  # a vector is copied for each block, so large components get larger ones
    rows = members.join(sizes, "component").withColumn("nb", F.ceil(F.col("size") / most)).withColumn("i", F.pmod(F.xxhash64("id"), F.col("nb")))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nb") - 1)))
    bucket = F.when(F.col("nb") == 1, F.pmod(F.xxhash64("component"), F.lit(partitions * 8))).otherwise(F.xxhash64("component"))
    rows = rows.select(bucket.alias("g"), F.least("i", "j").alias("bi"), F.greatest("i", "j").alias("bj"), "i", "component", "id", "copies", "dim", "unit")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        bi, bj = int(pdf["bi"].iloc[0]), int(pdf["bj"].iloc[0])
        for _, part in pdf.groupby(["component", "dim"], sort=False):
            x = np.frombuffer(b"".join(part["unit"]), np.float64).reshape(len(part), -1)
            i, ids, copies = part["i"].to_numpy(), part["id"].to_numpy(), part["copies"].to_numpy()
            for mine, its in (((i == bi), (i == bj)),) + ((((i == bj), (i == bi)),) if bi != bj else ()):
                u, v = np.flatnonzero(mine), np.flatnonzero(its)
                for s in range(0, len(u), 1024):
                    near = x[u[s : s + 1024]] @ x[v].T >= cosine
                    near &= u[s : s + 1024, None] != v[None, :]
                    out.append(pd.DataFrame({"id": ids[u[s : s + 1024]], "links": near @ copies[v]}))
        return pd.concat(out) if out else pd.DataFrame({"id": np.empty(0, np.int64), "links": np.empty(0, np.int64)})

    return rows.groupBy("g", "bi", "bj").applyInPandas(run, "id bigint, links bigint").groupBy("id").agg(F.sum("links").alias("links"))


def near_vectors(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE, recall: float = RECALL, window: int = WINDOW, bits: int = BITS, block: int = BLOCK, seed: int = SEED, exhaustive: bool = True) -> DataFrame:
    """key, n_links, component_id and kept for every row.

    Vectors that are null, empty or zero, or hold a null or non-finite component, link with nothing, and so do vectors of other
    dimensions. Equal vectors link with each other. Rows that share a key are one node; a row without a key has no component and isn't
    kept. Exactly the pairs that reach the cosine (in double precision) are linked; recall, window and bits only decide how many of them
    are known before all rows are compared. That last step takes time with the square of the rows; without it (`exhaustive=False`) no
    pair below the cosine is linked either, and of the pairs that reach it about `recall` are, fewer in dense parts.
    """
    spark = vectors.sparkSession
    e = F.col("embedding")
    good = F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False)) & F.col("id").isNotNull()
    rows = pick(vectors, key, embedding).select(F.col(key).cast("bigint").alias("id"), F.col(embedding).cast("array<double>").alias("embedding"))
    reps = cut(rows.where(good).groupBy("embedding").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "classes")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)

    count = reps.count()
    units = cut(keyed(reps, passes_for(count, window, cosine, recall), bits, seed), "units")
    placed = units.select("id", "unit", F.posexplode("keys").alias("pass", "key"), (F.col("dim") * 4096).alias("d")).select((F.col("d") + F.col("pass")).alias("group"), "key", "id", "unit")
    ordered = placed.repartitionByRange(parts, "group", "key", "id").sortWithinPartitions("group", "key", "id")
    found = cut(windowed(ordered, window, cosine), "windows")
    seam = across(found, window, cosine)
    links = cut(found.where("kind = 0").select("a", "b").unionAll(seam).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    discard(found)
    comps = cut(components(links), "tied")
    discard(links)
    if exhaustive:
        placed = units.select("id", "dim", "unit").join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        more = cut(missed(placed, cosine, max(SIDES, -(-count // ROWS))), "missed")
        tied, comps = comps, cut(components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more)), "components")
        discard(tied, more)

    members = comps.withColumnRenamed("node", "id").join(reps.select("id", "copies"), "id").join(units.select("id", "dim", "unit"), "id")
    counts = link_counts(members, cosine, block, parts)
    classes = cut(reps.join(comps.withColumnRenamed("node", "id"), "id", "left").join(counts, "id", "left").select("embedding", "id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "id").alias("c"), "copies"), "named")
    discard(units, reps, comps)
    single = rows.where(good).select("id", "embedding")
    named = single.join(classes.drop("id", "copies"), "embedding").select(F.col("id").alias(key), F.col("n").alias("n_links"), F.col("c").alias("component_id"))
    alone = rows.where(~good).select(F.col("id").alias(key), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return named.unionAll(alone).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))
