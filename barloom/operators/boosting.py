"""Gradient-boosted trees, several models at a time.

Rows of equal bins are summed to cells before anything is grown, and cells are kept as blocks of arrays in an RDD; a level
of a tree is one job without a shuffle, in which tasks sum their blocks per model, node, feature and bin. Work follows the
cells, of which there are at most as many as rows. Losses, bins, gains and importances are those of ``pyspark.ml``.
"""
from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from barloom.session import shared_folder

BINS = 32
SAMPLE = 10_000  # rows that the bounds of the bins are taken from; every row is fitted
TASK_ROWS = 100_000  # of all models; fewer are not worth a task
BLOCK = 1 << 17  # cells of a block
GROUPS = 8  # of a cell's rows, where trees see a share of the rows; a group is drawn as a whole
CHECKPOINT = 30  # trees between two cuts of the lineage
TREE = "tree int, feature array<int>, threshold array<double>, value array<double>, gain array<double>"


@dataclass(frozen=True)
class BoostedTrees:
    """Full trees as heaps: inner node k sends a row right where its feature is above the threshold (missing values too)."""

    names: tuple[str, ...]
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves, times the weight of the tree
    gain: np.ndarray

    @property
    def importances(self) -> np.ndarray:
        """Share of each feature in the gains of all splits."""
        sums = np.bincount(self.feature.ravel(), self.gain.ravel(), len(self.names))
        return sums / sums.sum() if sums.sum() else sums

    def score(self, x: np.ndarray) -> np.ndarray:
        out, at = np.zeros(len(x)), np.arange(len(x))
        depth = int(np.log2(self.value.shape[1]))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), "int32")
            for _ in range(depth):
                node = 2 * node + 2 - (x[at, feature[node]] <= threshold[node])
            out += value[node - (2**depth - 1)]
        return out

    def predict(self) -> Column:
        """Sum of the trees over the feature columns."""
        score = self.score

        @F.pandas_udf("double")
        def scored(*x: pd.Series) -> pd.Series:
            return pd.Series(score(np.column_stack([c.to_numpy("float64", na_value=np.nan) for c in x])))

        return scored(*[F.col(c).cast("double") for c in self.names])

    def probability(self) -> Column:
        """Probability of label 1 of trees fitted as a classifier."""
        return 1 / (1 + F.exp(-2 * self.predict()))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("pred", self.predict())

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(k, list(self.names), f.tolist(), t.tolist(), v.tolist(), g.tolist()) for k, (f, t, v, g) in enumerate(zip(self.feature, self.threshold, self.value, self.gain))]
        spark.createDataFrame(rows, TREE.replace("tree int,", "tree int, names array<string>,")).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedTrees:
        rows = spark.read.parquet(path).collect()  # one row a tree
        return _model(rows[0]["names"], rows)


def _model(names: Sequence[str], rows: Sequence) -> BoostedTrees:
    rows = sorted(rows, key=lambda r: r["tree"])
    return BoostedTrees(tuple(names), *[np.array([r[c] for r in rows]) for c in ("feature", "threshold", "value", "gain")])


def bin_bounds(x: np.ndarray, w: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Bounds between values: all of them, where they are few; else where the weight so far comes nearest to equal shares."""
    x, w = x[~np.isnan(x)], w[~np.isnan(x)]
    values, at = np.unique(x, return_inverse=True)
    weight = np.bincount(at, w, len(values))
    middle = (values[:-1] + values[1:]) / 2
    if len(values) <= bins:
        return middle
    out, stride = [], weight.sum() / bins
    target, so_far = stride, np.cumsum(weight)
    for k in range(1, len(values)):
        if abs(so_far[k - 1] - target) < abs(so_far[k] - target):
            out.append(middle[k - 1])
            target += stride
    return np.array(out)


def _drawn(h: np.ndarray, seed: int, tree: int, share: float) -> np.ndarray:
    """What a tree is grown on, by a hash, the seed and the tree."""
    with np.errstate(over="ignore"):
        z = h.view("uint64") + np.uint64(seed * 1_000_003 + tree + 1) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)) * 2.0**-53 < share


def _route(bins: np.ndarray, feature: np.ndarray, last: np.ndarray, levels: int) -> np.ndarray:
    """Node of each row at a level of a heap; a row goes right where its bin is above the node's last one on the left."""
    at, node = np.arange(bins.shape[1]), np.zeros(bins.shape[1], "int32")
    for level in range(levels):
        k = node + (2**level - 1)
        node = 2 * node + (bins[feature[k], at] > last[k])
    return node


def _sums(bins: np.ndarray, node: np.ndarray, n: np.ndarray, w: np.ndarray, wr: np.ndarray, nodes: int) -> np.ndarray:
    """Rows, weights and weighted residuals by node, feature and bin."""
    out, base = np.empty((3, nodes, len(bins), BINS)), node.astype("int64") * BINS
    for j, b in enumerate(bins):
        cell = base + b
        for i, v in enumerate((n, w, wr)):
            out[i, :, j] = np.bincount(cell, v, nodes * BINS).reshape(nodes, BINS)
    return out


def _best_splits(sums: np.ndarray, min_rows: int) -> tuple[np.ndarray, ...]:
    """Of each node: gain, feature, bin, mean left, mean right, own mean; gain 0: no split."""
    left = np.cumsum(sums, axis=-1)
    whole, left = left[..., -1:], left[..., :-1]
    right = whole - left
    (cl, wl, sl), (cr, wr, sr), (_, w, s) = left, right, whole
    with np.errstate(divide="ignore", invalid="ignore"):
        base = np.where(w > 0, s * s / w, 0.0)
        gain = sl * sl / wl + sr * sr / wr - base
        ok = (cl >= min_rows) & (cr >= min_rows) & (wl > 0) & (wr > 0) & (gain > 1e-12 * base)
        gain = np.where(ok, gain, 0.0)
        n = np.arange(len(gain))
        best = gain.reshape(len(gain), -1).argmax(axis=1)
        f, b = np.divmod(best, gain.shape[2])
        return gain[n, f, b], f, b, (sl / wl)[n, f, b], (sr / wr)[n, f, b], np.where(w > 0, s / w, 0.0)[:, 0, 0]


@dataclass(frozen=True)
class Block:
    """Cells of a model: bins by feature, number of rows, sums of weights and of weighted labels, a hash, and the score so far."""

    model: int
    bins: np.ndarray
    n: np.ndarray
    w: np.ndarray
    wy: np.ndarray
    h: np.ndarray
    score: np.ndarray


def fit_trees(df: DataFrame, features: Sequence[str], label: str, weight: str | None, trees: int, depth: int, rate: float, subsample: float, min_rows: int, seed: int, classify: bool = False, models: Sequence[Column] | None = None) -> list[BoostedTrees]:
    """Boosted regression trees on squared loss, or on logistic loss of a 0/1 label; each row counts ``weight`` times.

    ``models``: for each model, whether a row belongs to it; they grow side by side in the same jobs. A missing feature
    value goes right at every split. With ``subsample`` below 1 a tree sees that share of the rows: those of a cell are
    dealt to groups by a hash of all their columns, and each group is drawn as one. Python holds a few blocks at a time.
    """
    spark, names, models = df.sparkSession, list(features), [F.lit(True)] if models is None else list(models)
    hashed = [c.name for c in df.schema.fields if not isinstance(c.dataType, (MapType, VariantType))]
    d = df.select(
        *[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(names)], *[F.coalesce(m, F.lit(False)).alias(f"m{k}") for k, m in enumerate(models)],
        F.col(label).cast("double").alias("y"), (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("w"), F.xxhash64(*hashed).alias("h"))
    usable = F.col("y").isNotNull() & ~F.isnan("y") & F.col("w").isNotNull() & (F.col("w") >= 0)
    rows, good, *sizes = d.agg(F.count(F.lit(1)), F.count(F.when(usable, 1)), *[F.count(F.when(F.col(f"m{k}"), 1)) for k in range(len(models))]).first()
    if rows != good or not all(sizes):
        raise ValueError(f"{rows - good} of {rows} rows have no label or no weight of 0 or more; rows by model: {sizes}")
    bounds = []
    for k in range(len(models)):
        sample = d.where(f"m{k}").orderBy("h").limit(SAMPLE).toPandas()
        bounds.append([bin_bounds(sample[f"x{j}"].to_numpy("float64"), sample["w"].to_numpy()) for j in range(len(names))])
    cells = d.mapInArrow(_binned(bounds, classify, 1 if subsample >= 1 else GROUPS), "model int, bins binary, side double, part int, w double, wy double")
    cells = cells.groupBy("model", "bins", "side", "part").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("w").alias("w"), F.sum("wy").alias("wy"))
    cells = cells.select("model", "bins", "n", "w", "wy", F.xxhash64("bins", "part").alias("h"))
    tasks = max(1, min(spark.sparkContext.defaultParallelism, sum(sizes) // TASK_ROWS))
    shared_folder(spark)
    blocks = cells.repartition(tasks).mapInArrow(_packed, "block binary").rdd.map(lambda r: pickle.loads(r[0])).persist(StorageLevel.MEMORY_AND_DISK)
    grown = [[] for _ in models]
    for t in range(trees):
        if t:
            before, blocks = blocks, blocks.map(_scored([g[-1] for g in grown], depth)).persist(StorageLevel.MEMORY_AND_DISK)
            if t % CHECKPOINT == 0:
                blocks.checkpoint()
        heaps = [_Heap() for _ in models]
        for level in range(depth):
            parts = blocks.mapPartitions(_counted([(h.feature, h.last) for h in heaps], len(names), level, t, seed, subsample, classify)).collect()  # sums, one array a task
            for h, b, sums in zip(heaps, bounds, np.sum(parts, axis=0)):
                h.split(sums, b, min_rows)
            if t and not level:
                before.unpersist()
        for g, h in zip(grown, heaps):
            h.value = h.value * (rate if t else 1.0)
            g.append(h)
    blocks.unpersist()
    return [BoostedTrees(tuple(names), *[np.array([getattr(h, c) for h in g]) for c in ("feature", "threshold", "value", "gain")]) for g in grown]


def _binned(bounds: Sequence[Sequence[np.ndarray]], classify: bool, groups: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each model it belongs to, with a byte a feature."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            f, inside, (y, w, h) = x[:len(bounds[0])], x[len(bounds[0]):-3], x[-3:]
            y = 2 * y - 1 if classify else y
            side, part = y if classify else np.zeros(len(y)), (h % groups).astype("int32")
            for k, (b, m) in enumerate(zip(bounds, inside)):
                at = np.flatnonzero(m)
                key = np.column_stack([np.searchsorted(s, v[at]) for s, v in zip(b, f)]).astype("uint8")
                ends = np.arange(len(at) + 1, dtype="int32") * key.shape[1]
                bins = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(key.tobytes())])
                yield pa.record_batch([pa.array(np.full(len(at), k, "int32")), bins, *map(pa.array, (side[at], part[at], w[at], (w * y)[at]))], names=["model", "bins", "side", "part", "w", "wy"])

    return work


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of cells of one model."""
    held: dict[int, list] = {}

    def pack(k: int) -> pa.RecordBatch:
        bins, *rest = [np.concatenate(c, axis=-1) for c in zip(*held.pop(k))]
        return pa.record_batch([pa.array([pickle.dumps(Block(k, bins, *rest, np.zeros(len(rest[0]))), 5)], pa.binary())], names=["block"])

    for batch in batches:
        model, bins, *rest = batch.columns
        model, rest = model.to_numpy(), [c.to_numpy(zero_copy_only=False) for c in rest]
        bins = np.frombuffer(b"".join(bins.to_pylist()), "uint8").reshape(len(model), -1).T
        for k in np.unique(model).tolist():
            at = np.flatnonzero(model == k)
            held.setdefault(k, []).append([bins[:, at], *[c[at] for c in rest]])
            if sum(len(p[1]) for p in held[k]) >= BLOCK:
                yield pack(k)
    yield from [pack(k) for k in list(held)]


class _Heap:
    """A tree that grows by a level at a time."""

    def __init__(self):
        self.feature, self.last, self.threshold, self.gain = np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0), np.empty(0)
        self.alive, self.value = np.array([True]), None

    def split(self, sums: np.ndarray, bounds: Sequence[np.ndarray], min_rows: int) -> None:
        gain, f, b, left, right, mean = _best_splits(sums, min_rows)
        value = mean if self.value is None else self.value
        alive = self.alive & (gain > 0)
        self.feature = np.append(self.feature, np.where(alive, f, 0))
        self.last = np.append(self.last, np.where(alive, b, BINS))
        self.threshold = np.append(self.threshold, [bounds[j][k] if a else np.inf for j, k, a in zip(f, b, alive)])
        self.gain = np.append(self.gain, np.where(alive, gain, 0.0))
        self.value = np.column_stack([np.where(alive, left, value), np.where(alive, right, value)]).ravel()
        self.alive = np.repeat(alive, 2)


def _scored(heaps: Sequence[_Heap], depth: int) -> Callable[[Block], Block]:
    """A block after one more tree of its model."""
    trees = [(h.feature, h.last, h.value) for h in heaps]

    def work(x: Block) -> Block:
        feature, last, value = trees[x.model]
        return replace(x, score=x.score + value[_route(x.bins, feature, last, depth)])

    return work


def _counted(heaps: Sequence[tuple], features: int, level: int, tree: int, seed: int, subsample: float, classify: bool) -> Callable[[Iterator[Block]], Iterator[np.ndarray]]:
    """The sums of a task's blocks by model, for the nodes of a level."""
    def work(blocks: Iterator[Block]) -> Iterator[np.ndarray]:
        out = np.zeros((len(heaps), 3, 2**level, features, BINS))
        for x in blocks:
            bins, n, w, wy, score = x.bins, x.n, x.w, x.wy, x.score
            if subsample < 1:
                at = np.flatnonzero(_drawn(x.h, seed, tree, subsample))
                bins, n, w, wy, score = bins[:, at], n[at], w[at], wy[at], score[at]
            # A cell of a classifier has labels of one sign.
            wr = wy if not tree else 4 * wy / (1 + np.exp(2 * np.sign(wy) * score)) if classify else 2 * (wy - w * score)
            out[x.model] += _sums(bins, _route(bins, *heaps[x.model], level), n, w, wr, 2**level)
        yield out

    return work
