"""Nearest neighbours of many queries by an inverted file: rows in cells around centroids, queries against cells, in blocks.

Centroids are fitted on a bounded sample; every row is in the cell of its nearest centroid. A query first goes to the cells nearest to it,
which gives it a bound: its k-th distance so far. It then goes to every other cell that can hold something nearer, that is, whose centroid is
no farther than the bound and the cell's radius. So the result is that of a comparison with all rows, and what the first step alone would
have found can be measured against it.

Cells with many rows or many queries are split into blocks, and what a block finds for a query is at most k rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import stored

#: Rows that centroids are fitted on, at most about; cells, cells that a query goes to first, rows and queries of a block.
SAMPLE_ROWS, CELLS, PROBES = 10_000, 64, 4
ROW_BLOCK, QUERY_BLOCK = 20_000, 1_000
EPS = 1e-8


def matrix(col: pa.Array) -> np.ndarray:
    return np.asarray(col.flatten(), np.float64).reshape(len(col), -1)


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k-means; cells that lose all rows keep their place."""
    rng = np.random.default_rng(seed)
    c = sample[rng.permutation(len(sample))[:cells]].copy()
    for _ in range(rounds):
        near = nearest(sample, c)[0]
        for k in range(len(c)):
            mine = sample[near == k]
            if len(mine):
                c[k] = mine.mean(axis=0)
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Euclidean, by squares and products; never below 0."""
    d = (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None] - 2 * x @ c.T
    return np.sqrt(np.maximum(d, 0))


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = distances(x, c)
    k = d.argmin(axis=1)
    return k, d[np.arange(len(x)), k]


def unit(x: np.ndarray) -> np.ndarray:
    return x / (np.sqrt((x * x).sum(axis=1, keepdims=True)) + EPS)


def scores(q: np.ndarray, x: np.ndarray, by: str) -> np.ndarray:
    """Squared distance, or cosine with its guard against zero lengths, of pairs of rows."""
    if by == "l2":
        return ((q - x) ** 2).sum(axis=1)
    norm = lambda v: np.sqrt((v * v).sum(axis=1)) + EPS
    return (q * x).sum(axis=1) / (norm(q) * norm(x))


class Search:
    """An index over the rows of `index` (id, vector). Rows without a vector, with missing or non-finite components, or with another number of
    components than most rows have are not found."""

    def __init__(self, index: DataFrame, by: str = "l2", id_col: str = "vec_id", vector: str = "embedding", cells: int = CELLS, sample_rows: int = SAMPLE_ROWS, row_block: int = ROW_BLOCK) -> None:
        self.by, self.row_block = by, row_block
        good = F.col("_v").isNotNull() & (F.size("_v") > 0) & ~F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        rows = index.select(F.col(id_col).cast("bigint").alias("_id"), F.col(vector).cast("array<double>").alias("_v")).where(good)
        self.dim = rows.agg(F.mode(F.size("_v"), True)).first()[0] or 0  # of most rows; the smallest of equally many
        rows = rows.where(F.size("_v") == self.dim)
        n = rows.count()
        picked = rows if n <= sample_rows else rows.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(1_000_000 * sample_rows / n))
        sample = np.array([r._v for r in picked.select("_v").collect()], np.float64)
        self.centroids = c = fit_centroids(self.placed(sample), min(cells, len(sample))) if len(sample) else np.zeros((1, 1))
        placed = self.placed

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell, d = nearest(placed(matrix(b.column(1))), c) if b.num_rows else (np.zeros(0, np.int64), np.zeros(0))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype(np.int32)), pa.array(d)], names=["_id", "_v", "_cell", "_d"])

        self.rows = stored(rows.mapInArrow(assign, "_id bigint, _v array<double>, _cell int, _d double"), "cells")
        stats = self.rows.groupBy("_cell").agg(F.count("*").alias("n"), F.max("_d").alias("r")).collect()  # a row for each cell
        self.count, self.radius = np.zeros(len(c), np.int64), np.full(len(c), -np.inf)
        for s in stats:
            self.count[s._cell], self.radius[s._cell] = s.n, s.r

    @property
    def placed(self):
        """Where vectors stand for the cells: as they are, or at length one, where the nearest has the largest cosine."""
        return unit if self.by == "cosine" else (lambda x: x)

    def _probe(self, pairs: DataFrame, k: int, query_block: int) -> DataFrame:
        """(query, id, score) of the k best rows of every block that a pair (query, vector, cell) names."""
        by, largest = self.by, self.by == "cosine"
        asked = {r._cell: r.n for r in pairs.groupBy("_cell").agg(F.count("*").alias("n")).collect()}  # a row for each cell
        blocks = [(c, max(1, -(-int(self.count[c]) // self.row_block)), max(1, -(-asked[c] // query_block))) for c in asked if self.count[c]]
        spread = pairs.sparkSession.createDataFrame(blocks, "_cell int, _rb bigint, _qb bigint")
        left = self.rows.join(F.broadcast(spread), "_cell").select("_id", "_v", "_cell", F.pmod(F.xxhash64("_id"), "_rb").alias("_rb"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_qb") - 1)).alias("_qb"))
        right = pairs.join(F.broadcast(spread), "_cell").select("_query", "_q", "_cell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_rb") - 1)).alias("_rb"), F.pmod(F.xxhash64("_query"), "_qb").alias("_qb"))

        def best(rows: pa.Table, asks: pa.Table) -> pa.Table:
            out: list[tuple] = []
            if rows.num_rows and asks.num_rows:
                x, q = matrix(rows.column("_v").combine_chunks()), matrix(asks.column("_q").combine_chunks())
                ids, queries = np.asarray(rows.column("_id")), np.asarray(asks.column("_query"))
                rough = distances(unit(q), unit(x)) if largest else distances(q, x)
                for i in range(len(q)):
                    d = rough[i]
                    # products lose digits: rows within them of the k-th are scored as well
                    limit = np.partition(d, k - 1)[k - 1] + 1e-6 * (1 + d.max()) if len(d) > k else np.inf
                    at = np.flatnonzero(d <= limit)
                    s = scores(q[i : i + 1], x[at], by)
                    order = np.lexsort((ids[at], -s if largest else s))[:k]
                    out += [(queries[i], ids[at[j]], s[j]) for j in order]
            cols = list(zip(*out)) if out else [[], [], []]
            return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["_query", "_id", "score"])

        keys = ["_cell", "_rb", "_qb"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, "_query bigint, _id bigint, score double")

    def _top(self, found: DataFrame, k: int) -> DataFrame:
        w = Window.partitionBy("_query").orderBy(F.desc("score") if self.by == "cosine" else F.asc("score"), "_id")
        return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)

    def _pairs(self, queries: DataFrame, probes: int, bounded: bool) -> DataFrame:
        """(query, vector, cell): the `probes` nearest cells, or with a bound all others that may hold something nearer."""
        c, radius, placed, largest = self.centroids, self.radius, self.placed, self.by == "cosine"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                d = distances(placed(matrix(b.column(1))), c)
                first = np.argsort(d, axis=1, kind="stable")[:, :probes]
                take = np.zeros(d.shape, bool)
                np.put_along_axis(take, first, True, axis=1)
                if bounded:
                    worst = np.asarray(b.column(2), np.float64)  # the k-th score; nan: fewer than k
                    reach = np.sqrt(np.maximum(2 - 2 * worst, 0) if largest else worst)
                    reach = np.where(np.isnan(reach), np.inf, reach) + 1e-6 * (1 + np.abs(d).max())
                    take = ~take & (d - radius[None] <= reach[:, None])
                q, cell = np.nonzero(take & np.isfinite(radius)[None])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(q)), b.column(1).take(pa.array(q)), pa.array(cell.astype(np.int32))], names=["_query", "_q", "_cell"])

        return stored(queries.mapInArrow(run, "_query bigint, _q array<double>, _cell int"), "pairs")

    def top_k(self, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", probes: int = PROBES, exact: bool = True, query_block: int = QUERY_BLOCK) -> DataFrame:
        """(query, id, score, place): the k nearest rows of every query, ties by id. Without `exact`, those of the first cells alone.

        Queries are rows with distinct ids; those without a proper vector have no neighbours.
        """
        good = F.col("_q").isNotNull() & (F.size("_q") > 0) & ~F.exists("_q", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        asks = queries.select(F.col(id_col).cast("bigint").alias("_query"), F.col(vector).cast("array<double>").alias("_q")).where(good & (F.size("_q") == self.dim))
        first = stored(self._top(self._probe(self._pairs(asks, probes, False), k, query_block), k), "first")
        if not exact:
            return first
        worst = first.where(F.col("place") == k).select("_query", F.col("score").alias("_worst"))
        bounds = asks.join(worst, "_query", "left").withColumn("_worst", F.coalesce("_worst", F.lit(float("nan"))))
        rest = self._probe(self._pairs(bounds, probes, True), k, query_block)
        return self._top(first.drop("place").unionByName(rest), k)


def recall(found: DataFrame, wanted: DataFrame) -> float:
    """The share of the wanted (query, id) pairs that are found."""
    pairs = wanted.select("_query", "_id")
    n = pairs.count()
    return pairs.join(found.select("_query", "_id"), ["_query", "_id"], "left_semi").count() / n if n else 1.0
