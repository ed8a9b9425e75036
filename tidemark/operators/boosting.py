"""Gradient-boosted trees over binned features, grown from histograms that Spark sums up.

Edges of the bins are found once and stay with the booster. A round grows one tree for each class: tasks sum gradients, Hessians and counts
by (class, node, feature, bin), Spark adds up what the tasks found, and the driver, which sees histograms alone, takes splits from a queue
of gains, largest first. A step asks for the histograms of every node that the queue may need next, so that a tree takes about as many
steps as it has levels. A booster can be stored and continued with other rows: its trees stay, further ones are fitted to what they leave.

`fit_local` grows the same trees from the same histograms in one task, for samples of a bounded size.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import stored

CLASSES = 3
#: Bins of a feature, the one of missing values included, and rounds after which margins are written anew.
MAX_BINS, KEEP_ROUNDS = 64, 10
#: Histograms of so few tasks are added up as they come in; those of more tasks are summed by Spark first.
FEW_PARTS = 16
#: Relative error of approximate quantiles is 1 / ACCURACY.
ACCURACY = 100_000
NAMES = ("prob_down", "prob_flat", "prob_up")


@dataclass(frozen=True)
class Params:
    learning_rate: float = 0.05
    #: None: as many as the depth allows
    num_leaves: int | None = 31
    #: None: no limit
    max_depth: int | None = None
    l1: float = 0.0
    l2: float = 1.0
    #: the least loss that a split has to take off
    gamma: float = 0.0
    min_rows: int = 1
    min_hessian: float = 1e-3
    feature_fraction: float = 1.0
    row_fraction: float = 1.0
    seed: int = 7


@dataclass(frozen=True)
class Tree:
    """Nodes by number from the root, 0: the feature of a split (-1: a leaf), the largest bin that goes left, whether missing values go
    left, both children, and the leaf's value."""

    feature: list[int]
    bin: list[int]
    missing_left: list[bool]
    left: list[int]
    right: list[int]
    value: list[float]

    def values(self, bins: np.ndarray) -> np.ndarray:
        f, t, m, a, b = (np.asarray(x) for x in (self.feature, self.bin, self.missing_left, self.left, self.right))
        node = np.zeros(len(bins), np.int64)
        while True:
            at = np.flatnonzero(f[node] >= 0)
            if not len(at):
                return np.asarray(self.value)[node]
            n = node[at]
            x = bins[at, f[n]]
            node[at] = np.where(np.where(x == 0, m[n], x <= t[n]), a[n], b[n])


@dataclass
class Booster:
    """Edges by feature, and the trees of all classes by round."""

    features: list[str]
    edges: list[list[float]]
    rounds: list[list[Tree]] = field(default_factory=list)
    #: log loss of the rows held out, by round, of the last fit
    losses: list[float] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        """0 for missing values, else 1 and the number of edges below the value."""
        out = np.empty(x.shape, np.uint8)
        for k, e in enumerate(self.edges):
            out[:, k] = np.where(np.isnan(x[:, k]), 0, 1 + np.searchsorted(np.asarray(e, np.float64), x[:, k], side="left"))
        return out

    def margins(self, bins: np.ndarray, since: int = 0) -> np.ndarray:
        out = np.zeros((len(bins), CLASSES))
        for trees in self.rounds[since:]:
            for k, t in enumerate(trees):
                out[:, k] += t.values(bins)
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.margins(self.bins(x)))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Booster:
        d = json.loads(text)
        return Booster(d["features"], d["edges"], [[Tree(**t) for t in r] for r in d["rounds"]], d["losses"])


def softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(margins: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the weighted log loss, by class."""
    p = softmax(margins)
    g = p.copy()
    g[np.arange(len(y)), y] -= 1
    return g * w[:, None], np.maximum(CLASSES / (CLASSES - 1) * p * (1 - p), 1e-16) * w[:, None]


def drawn(keys: np.ndarray, seed: int, number: int, fraction: float) -> np.ndarray:
    """Which rows a round uses: by their keys alone, so in the same way wherever they lie."""
    if fraction >= 1:
        return np.ones(len(keys), bool)
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64) + np.uint64((seed * 1_000_003 + number + 1) & (2**64 - 1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))) / 2.0**64 < fraction


def histogram(bins: np.ndarray, g: np.ndarray, h: np.ndarray, slot: np.ndarray, slots: int) -> np.ndarray:
    """(slots, features, MAX_BINS, 3): sums of g, h and 1 over rows by slot (-1: not counted), feature and bin."""
    use = slot >= 0
    bins, g, h, slot = bins[use], g[use], h[use], slot[use].astype(np.int64)
    out = np.zeros((slots, bins.shape[1], MAX_BINS, 3))
    for f in range(bins.shape[1]):
        at = slot * MAX_BINS + bins[:, f]
        for i, x in enumerate((g, h, None)):
            out[:, f, :, i] = np.bincount(at, x, slots * MAX_BINS).reshape(slots, MAX_BINS)
    return out


@dataclass
class Split:
    gain: float
    feature: int = -1
    bin: int = 0
    missing_left: bool = False
    left: tuple = ()
    right: tuple = ()


def _score(g: np.ndarray, h: np.ndarray, p: Params) -> np.ndarray:
    return np.maximum(np.abs(g) - p.l1, 0) ** 2 / np.maximum(h + p.l2, 1e-300) / 2


def best_splits(hists: np.ndarray, p: Params, allowed: Sequence[int]) -> list[Split]:
    """The split of each of (nodes, features, MAX_BINS, 3) with the largest gain; of equals the first feature, missing values right, the
    first bin. No gain: no split."""
    hists = hists[:, allowed]
    total, missing = hists.sum(axis=2)[:, :, None, None], hists[:, :, None, None, 0]
    below = np.cumsum(hists[:, :, 1:], axis=2)[:, :, None, :-1]  # values up to each bin but the last
    left = np.concatenate([below, below + missing], axis=2)  # node, feature, missing right or left, bin, sum
    right = total - left
    ok = (left[..., 2] >= max(1, p.min_rows)) & (right[..., 2] >= max(1, p.min_rows)) & (left[..., 1] >= p.min_hessian) & (right[..., 1] >= p.min_hessian)
    ok[:, :, 1] &= (missing[..., 2] > 0)[..., 0]
    gain = np.where(ok, _score(left[..., 0], left[..., 1], p) + _score(right[..., 0], right[..., 1], p) - _score(total[..., 0], total[..., 1], p) - p.gamma, -np.inf)
    flat = gain.reshape(len(hists), -1)
    at = (flat >= flat.max(axis=1, keepdims=True) - 1e-10).argmax(axis=1)  # sums in another order differ in their last digits
    out = []
    for n, k in enumerate(at.tolist()):
        f, m, t = np.unravel_index(k, gain.shape[1:])
        out.append(Split(float(flat[n, k]), allowed[f], int(t) + 1, bool(m), tuple(left[n, f, m, t]), tuple(right[n, f, m, t])) if flat[n, k] > 1e-10 else Split(0.0))
    return out


class Growing:
    """A tree that grows as histograms come in. Every node that has been split in thought has children; the queue decides which stay."""

    def __init__(self, p: Params, allowed: Sequence[int]) -> None:
        self.p, self.allowed = p, allowed
        self.split: list[Split | None] = [None]
        self.kids: list[tuple[int, int] | None] = [None]
        self.sums: list[tuple] = [()]
        self.depth = [0]
        self.leaves: list[int] = [0]
        self.wanted: list[int] = [0]

    def offer(self, nodes: Sequence[int], hists: np.ndarray) -> None:
        if nodes[0] == 0:
            self.sums[0] = tuple(hists[0, 0].sum(axis=0))
        for node, s in zip(nodes, best_splits(hists, self.p, self.allowed)):
            self.split[node] = s
            if s.feature < 0:
                continue
            self.kids[node] = (len(self.split), len(self.split) + 1)
            for sums in (s.left, s.right):
                d = self.depth[node] + 1
                hopeless = (self.p.max_depth is not None and d >= self.p.max_depth) or sums[2] < 2 * self.p.min_rows
                self.split.append(Split(0.0) if hopeless else None)
                self.kids.append(None)
                self.sums.append(sums)
                self.depth.append(d)

    def advance(self) -> None:
        """Takes splits from the queue while their gains are known, and finds the nodes whose histograms are wanted next."""
        limit = self.p.num_leaves or 1 << 62
        self.leaves, self.wanted = [0], []
        while len(self.leaves) < limit:
            if any(self.split[n] is None for n in self.leaves):
                near = self.leaves + [k for n in self.leaves for k in self.kids[n] or ()]
                self.wanted = [n for n in near if self.split[n] is None]
                return
            best = max(self.leaves, key=lambda n: (self.split[n].gain, -n))
            if self.split[best].feature < 0:
                return
            self.leaves.remove(best)
            self.leaves += self.kids[best]

    def place(self, bins: np.ndarray, node: np.ndarray | None = None) -> np.ndarray:
        """The deepest node of every row, from the root or from where the rows stand."""
        node = np.zeros(len(bins), np.int64) if node is None else node
        inner = [k is not None for k in self.kids]
        f, t, m = (np.asarray([getattr(s, n) if i else 0 for s, i in zip(self.split, inner)]) for n in ("feature", "bin", "missing_left"))
        kids, inner = np.asarray([k or (0, 0) for k in self.kids]), np.asarray(inner)
        at = np.flatnonzero(inner[node])
        while len(at):
            n = node[at]
            x = bins[at, f[n]]
            node[at] = np.where(np.where(x == 0, m[n], x <= t[n]), kids[n, 0], kids[n, 1])
            at = at[inner[node[at]]]
        return node

    def tree(self) -> Tree:
        """The tree of the leaves that the queue has left, numbered anew."""
        order, number = [0], {0: 0}
        keep = set(self.leaves)
        for n in order:
            if n not in keep:
                for k in self.kids[n]:
                    number[k] = len(order)
                    order.append(k)
        g = lambda n: self.sums[n][0]
        value = lambda n: -np.sign(g(n)) * max(abs(g(n)) - self.p.l1, 0) / max(self.sums[n][1] + self.p.l2, 1e-300) * self.p.learning_rate
        inner = lambda n, a, b: a if n not in keep else b
        return Tree(
            [inner(n, self.split[n], Split(0.0)).feature for n in order], [inner(n, self.split[n], Split(0.0)).bin for n in order], [inner(n, self.split[n], Split(0.0)).missing_left for n in order],
            [number[self.kids[n][0]] if n not in keep else -1 for n in order], [number[self.kids[n][1]] if n not in keep else -1 for n in order], [float(value(n)) if n in keep else 0.0 for n in order],
        )


def allowed_features(p: Params, number: int, k: int, features: int) -> list[int]:
    """The features that the tree of a round and class may use."""
    take = max(1, round(p.feature_fraction * features))
    return sorted(np.random.default_rng([p.seed, number, k]).permutation(features)[:take].tolist())


def loss_of(margins: np.ndarray, y: np.ndarray) -> float:
    return float(-np.log(np.maximum(softmax(margins)[np.arange(len(y)), y], 1e-15)).sum())


def _boost(b: Booster, p: Params, rounds: int, patience: int | None, step: Callable[[list[Growing], int], tuple[dict, float | None]]) -> Booster:
    """Adds rounds. `step` gives the histograms of all wanted nodes by (class, node), and the loss so far of the rows held out."""
    start, best, losses = len(b.rounds), (np.inf, len(b.rounds)), []

    def stop(loss: float | None) -> bool:
        nonlocal best
        if loss is None or patience is None:
            return False
        losses.append(loss)
        if loss < best[0]:
            best = (loss, len(b.rounds))
        return len(b.rounds) - best[1] >= patience

    for r in range(start, start + rounds):
        growing = [Growing(p, allowed_features(p, r, k, len(b.features))) for k in range(CLASSES)]
        hists, loss = step(growing, r)
        if stop(loss):
            break
        while True:
            for k, g in enumerate(growing):
                if g.wanted:
                    g.offer(g.wanted, np.stack([hists[k, n] for n in g.wanted]))
                    g.advance()
            if not any(g.wanted for g in growing):
                break
            hists, _ = step(growing, r)
        trees = [g.tree() for g in growing]
        if all(len(t.feature) == 1 and t.value[0] == 0 for t in trees):
            break
        b.rounds.append(trees)
    else:
        if patience is not None:
            stop(step([], start + rounds)[1])
    if patience is not None and losses:
        b.rounds = b.rounds[: best[1]]
    b.losses = losses
    return b


def fit_local(x: np.ndarray, y: np.ndarray, p: Params, rounds: int, features: list[str], keys: np.ndarray | None = None, weight: np.ndarray | None = None, init: Booster | None = None, edges: list[list[float]] | None = None, valid: tuple[np.ndarray, np.ndarray] | None = None, patience: int | None = None) -> Booster:
    """A booster of rows that are here; keys are what rows are drawn by."""
    b = Booster(list(features), init.edges, list(init.rounds)) if init else Booster(list(features), edges if edges is not None else local_edges(x))
    bins, w = b.bins(x), np.ones(len(y)) if weight is None else weight
    keys = np.arange(len(y)) if keys is None else keys
    held = b.bins(valid[0]) if valid is not None else None
    state = {"rounds": 0, "m": np.zeros((len(y), CLASSES)), "held": None if held is None else np.zeros((len(held), CLASSES))}

    def step(growing: list[Growing], number: int) -> tuple[dict, float | None]:
        if state["rounds"] < len(b.rounds):
            state["m"] = state["m"] + b.margins(bins, state["rounds"])
            if held is not None:
                state["held"] = state["held"] + b.margins(held, state["rounds"])
            state["rounds"] = len(b.rounds)
        if all(tree.wanted == [0] for tree in growing):
            state["g"], state["h"] = gradients(state["m"], y, w)
            state["use"], state["node"] = drawn(keys, p.seed, number, p.row_fraction), [None] * CLASSES
        g, h, use, out = state["g"], state["h"], state["use"], {}
        for k, tree in enumerate(growing):
            if tree.wanted:
                slot = np.full(len(tree.split), -1)
                slot[tree.wanted] = np.arange(len(tree.wanted))
                state["node"][k] = tree.place(bins, state["node"][k])
                got = histogram(bins, g[:, k], h[:, k], np.where(use, slot[state["node"][k]], -1), len(tree.wanted))
                out |= {(k, n): got[i] for i, n in enumerate(tree.wanted)}
        return out, None if held is None else loss_of(state["held"], valid[1]) / max(1, len(valid[1]))

    return _boost(b, p, rounds, patience, step)


def local_edges(x: np.ndarray) -> list[list[float]]:
    at = np.linspace(0, 1, MAX_BINS - 1)[1:-1]
    return [sorted({float(v) for v in np.quantile(c[~np.isnan(c)], at, method="inverted_cdf")}) if (~np.isnan(c)).any() else [] for c in x.T]


def feature_edges(df: DataFrame, features: Sequence[str]) -> list[list[float]]:
    """Edges between the bins of every feature: quantiles by a mergeable sketch, in one pass."""
    at = F.array(*[F.lit(i / (MAX_BINS - 2)) for i in range(1, MAX_BINS - 2)])
    clean = [F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")).alias(f) for f in features]
    row = df.select(*clean).agg(*[F.percentile_approx(f, at, ACCURACY).alias(f) for f in features]).first()
    return [sorted(set(row[f] or [])) for f in features]


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    """An array<double> column as rows; nulls are NaN."""
    flat = pa.compute.fill_null(col.flatten().cast(pa.float64()), float("nan")) if len(col) else pa.array([], pa.float64())
    return np.asarray(flat, np.float64).reshape(len(col), width)


def fit(df: DataFrame, features: Sequence[str], label: str, p: Params, rounds: int, key: str | None = None, weight: str | None = None, valid: str | None = None, patience: int | None = None, init: Booster | None = None, few_parts: int = FEW_PARTS) -> Booster:
    """A booster of all rows of df, or `init` continued with them.

    label: 0, 1 or 2; rows with another or a null label are left out. `valid` names a boolean column: rows where it is true are held out,
    and growth stops when their log loss has not fallen for `patience` rounds, and goes back to the best round. `key` names the column that
    rows are drawn by (distinct numbers; by default a hash of the features). Missing features have a bin of their own. Without rows
    to train on the booster stays as it is.
    """
    spark, features = df.sparkSession, list(features)
    numbers = [F.col(f).cast("double") for f in features]
    rows = df.where(F.col(label).isin(0, 1, 2)).select(
        F.array(*numbers).alias("_x"), F.col(label).cast("int").alias("_y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"), (F.col(key).cast("bigint") if key else F.xxhash64(*numbers)).alias("_k"), (F.coalesce(F.col(valid), F.lit(False)) if valid else F.lit(False)).alias("_v"),
    )
    b = Booster(features, init.edges, list(init.rounds)) if init else Booster(features, feature_edges(df, features))
    width = len(features)
    kept = {"rounds": len(b.rounds), "table": None}

    def with_margins(table: DataFrame, since: int, raw: bool) -> DataFrame:
        """The rows with bins instead of features, and margins of all rounds so far."""
        now = Booster(b.features, b.edges, list(b.rounds))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in batches:
                bins = now.bins(_matrix(r.column(0), width)) if raw else np.frombuffer(b"".join(r.column(0).to_pylist()), np.uint8).reshape(-1, width)
                m = now.margins(bins, since) + (0.0 if raw else _matrix(r.column(5), CLASSES))
                packed = pa.array([x.tobytes() for x in bins], pa.binary())
                yield pa.RecordBatch.from_arrays([packed, *r.columns[1:5], pa.ListArray.from_arrays(np.arange(0, 3 * len(m) + 1, 3, dtype=np.int32), pa.array(m.ravel()))], names=["_x", "_y", "_w", "_k", "_v", "_m"])

        return stored(table.mapInArrow(run, "_x binary, _y int, _w double, _k bigint, _v boolean, _m array<double>"), "boosting")

    # even partitions of the size that Spark advises: every step reads them
    kept["table"] = with_margins(rows.hint("rebalance"), 0, True)
    kept["parts"] = kept["table"].rdd.getNumPartitions()

    def step(growing: list[Growing], number: int) -> tuple[dict, float | None]:
        if len(b.rounds) - kept["rounds"] >= KEEP_ROUNDS:
            kept["table"] = with_margins(kept["table"], kept["rounds"], False)
            kept["rounds"] = len(b.rounds)
        now, since = Booster(b.features, b.edges, list(b.rounds)), kept["rounds"]
        first = all(g.wanted == [0] for g in growing)
        scored = patience is not None and first

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            loss, held = 0.0, 0
            for r in batches:
                bins = np.frombuffer(b"".join(r.column(0).to_pylist()), np.uint8).reshape(-1, width)
                y, w, keys, v = (np.asarray(r.column(i)) for i in range(1, 5))
                m = _matrix(r.column(5), CLASSES) + now.margins(bins, since)
                if scored and v.any():
                    loss, held = loss + loss_of(m[v], y[v]), held + int(v.sum())
                g, h = gradients(m, y, w)
                use = drawn(keys, p.seed, number, p.row_fraction) & ~v
                for k, tree in enumerate(growing):
                    if tree.wanted:
                        slot = np.full(len(tree.split), -1)
                        slot[tree.wanted] = np.arange(len(tree.wanted))
                        got = histogram(bins, g[:, k], h[:, k], np.where(use, slot[tree.place(bins)], -1), len(tree.wanted))
                        total[k] = total[k] + got if k in total else got
            out = [np.array([[-1, 0, 0, 0, loss, 0.0, held]])] if held else []
            for k, got in total.items():
                s, f, x = np.nonzero(got[..., 2])
                out.append(np.column_stack([np.full(len(s), k), np.asarray(growing[k].wanted)[s], f, x, got[s, f, x]]))
            cells = np.concatenate(out) if out else np.empty((0, 7))
            whole = [pa.array(cells[:, i].astype(np.int32)) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*whole, pa.array(cells[:, 4]), pa.array(cells[:, 5]), pa.array(cells[:, 6].astype(np.int64))], names=["k", "node", "f", "bin", "g", "h", "n"])

        parts = kept["table"].mapInArrow(run, "k int, node int, f int, bin int, g double, h double, n bigint")
        # as many rows as there are classes, wanted nodes, features and bins, whatever the data's size
        if kept["parts"] > few_parts:
            parts = parts.groupBy("k", "node", "f", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
        hists = {(k, n): np.zeros((width, MAX_BINS, 3)) for k, t in enumerate(growing) for n in t.wanted}
        held = np.zeros(2)
        for c in parts.collect():
            if c.k < 0:
                held += c.g, c.n
            else:
                hists[c.k, c.node][c.f, c.bin] += c.g, c.h, c.n
        return hists, held[0] / held[1] if held[1] else None

    return _boost(b, p, rounds, patience, step)


def predict(df: DataFrame, b: Booster, names: Sequence[str] = NAMES) -> DataFrame:
    """df with the probabilities of the three classes."""
    width = len(b.features)

    @F.arrow_udf(", ".join(f"{n} double" for n in names))
    def run(x: pa.Array) -> pa.Array:
        p = b.probabilities(_matrix(x, width))
        return pa.StructArray.from_arrays([pa.array(c) for c in p.T], names=list(names))

    made = df.withColumn("_p", run(F.array(*[F.col(f).cast("double") for f in b.features])))
    return made.withColumns({n: F.col("_p")[n] for n in names}).drop("_p")


def save(b: Booster, spark, path: str) -> None:
    """The booster as a one-row table; it holds trees and edges, no data."""
    spark.createDataFrame([(b.to_json(),)], "booster string").write.mode("overwrite").parquet(path)


def load(spark, path: str) -> Booster:
    return Booster.from_json(spark.read.parquet(path).first().booster)
