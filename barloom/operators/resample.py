"""Resampling statistics at thousands of simulations.

Values are stored once as blocks of a few thousand. Statistics that are sums (means, win rates, Sharpe) never list a draw: the
draws of a simulation are split binomially over halves of the blocks down to one block, which gets their number and
draws within itself, so every block is read once. Paths need their draws in order: a task walks some simulations from their
first step to their last in tiles of steps, and fills a tile while the blocks stream past from the shared folder. Percentiles over all
simulations take segments of steps instead: their sums, carried forward, give each segment its starting equity, and a second
pass over the same draws then knows the equity of every step.

Draws are hashed from (seed, key, simulation, step) or from nodes of the split, so results do not depend on partitioning.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, lru_cache
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalar import hash_long
from barloom.operators.scan import day_of, with_ordinal
from barloom.session import cut, kept

BLOCK = 4096  # values in a stored block
TOGETHER = 1 << 22  # values that are looked up together while blocks stream
BUFFER = 1 << 21  # draws that a task makes together
NEAR = 1 << 17  # and of these so many at a time, which stay near a core
HELD = 1 << 24  # draws of a tile: for every tile a task reads all values of its key from the shared folder
TOGETHER_SIMS = 50  # simulations that a task walks from their first step to their last
# Factors of the draws' 32-bit mixer, also stated in SQL.
A, B, C = 2654435761, 2246822519, 3266489917


# --- draws -------------------------------------------------------------------------------------------

def mixed(h: np.ndarray) -> np.ndarray:
    """A mixer of the lower 32 bits."""
    h = h.astype(np.uint32)
    for shift, factor in ((15, B), (13, C)):
        h ^= h >> np.uint32(shift)
        h *= np.uint32(factor)
    h ^= h >> np.uint32(16)
    return h


def _low(x: np.ndarray | int) -> np.ndarray:
    """The lower 32 bits."""
    return np.asarray(x).astype(np.uint64).astype(np.uint32)


def hashed(code: int, sims: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """53 random bits for each (simulation, step); ``code``: 48 bits of seed and key."""
    sims, steps = _low(sims)[:, None], _low(steps)[None, :]
    hi = mixed(mixed(sims * np.uint32(A) + _low(code & 0xFFFFFFFF)) + steps * np.uint32(A)).astype(np.uint64)
    hi <<= np.uint64(21)
    hi |= mixed(mixed(sims * np.uint32(B) + _low(code >> 16)) + steps * np.uint32(C)) >> np.uint32(11)
    return hi


def with_replacement(code: int, sims: np.ndarray, steps: np.ndarray, n: int) -> np.ndarray:
    """Position, from 0, that each step of each simulation draws."""
    bits = hashed(code, sims, steps)
    whole = bits // np.uint64(n)  # numpy divides by one number faster than it takes remainders
    whole *= np.uint64(n)
    bits -= whole
    return bits.view(np.int64)


def shuffled(code: int, sims: np.ndarray, steps: np.ndarray, n: int) -> np.ndarray:
    """Position of each step in a random order of its simulation: a Feistel network whose walk stays inside 0..n-1.

    A number is a row and a place in a rectangle just large enough; in turn each is shifted by a hash of the other. What
    lies beyond n - 1, less than a row, walks on. Few values take more turns, else some orders come up more often than others.
    """
    rows = isqrt(n - 1) + 1
    cols = -(-n // rows)
    word = np.uint32 if rows * cols < 1 << 32 else np.uint64
    keys = [(k + (k >> np.uint64(21))).astype(np.uint32) for k in (hashed(code, sims, np.arange(r, r + 1))[:, :1] for r in range(4 if n >= 4096 else 12))]

    def walked(x: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
        own = x // word(cols)
        other, size, beside = x - own * word(cols), rows, cols
        for k in keys:
            turned = other.astype(np.uint32) * np.uint32(A)
            turned += k
            turned = mixed(turned).astype(np.uint64)
            turned *= np.uint64(size)
            turned >>= np.uint64(32)  # evenly below the size
            turned = turned.astype(word, copy=False)
            turned += own
            np.minimum(turned, turned - word(size), out=turned)  # below 0 wraps to the largest
            own, other, size, beside = other, turned, beside, size
        return own * word(cols) + other

    x = walked(np.broadcast_to(steps.astype(word)[None, :], (len(sims), len(steps))), keys).ravel()
    out = np.flatnonzero(x >= n)
    while len(out):  # only those outside walk on
        x[out] = walked(x[out], [k.ravel()[out // len(steps)] for k in keys])
        out = out[x[out] >= n]
    return x.reshape(len(sims), len(steps)).astype(np.int64)


DRAWS: dict[str, Callable] = {"bootstrap": with_replacement, "shuffle": shuffled}


# --- stored values -----------------------------------------------------------------------------------

def value_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, seed: int = 42, block: Column | None = None) -> DataFrame:
    """The non-null values of each key in order, as rows (keys, code, n, blk, xs) of ``BLOCK`` values, written once."""
    keys = list(keys)
    d = df.where(F.col(value).isNotNull()).select(*keys, *[c for c in order if c not in keys], F.col(value).cast("double").alias("__x"))
    d = with_ordinal(d, keys, order, day_of(order[0]) if block is None else block, "__k")
    item = F.struct(F.col("__k").alias("k"), F.col("__x").alias("x"))
    b = d.groupBy(*keys, F.floor((F.col("__k") - 1) / BLOCK).alias("blk")).agg(F.array_sort(F.collect_list(item)).alias("b"))
    b = cut(b.select(*keys, "blk", F.col("b.x").alias("xs")))
    n = b.groupBy(*keys).agg(F.sum(F.size("xs")).alias("n"))
    return b.join(n, keys).withColumn("code", hash_long(F.lit(seed), *[F.col(k) for k in keys]))


def _dealt(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt to as many tasks as there are shuffle partitions, however few bytes they hold: the work is in the draws."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *[F.col(c) for c in by])


def _kinds(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in names)


def _repeated(batch: pa.RecordBatch, row: int, keys: Sequence[str], times: int) -> list[pa.Array]:
    return [batch.column(k).take(pa.array(np.full(times, row))) for k in keys]


# --- sums: draws as numbers per block ----------------------------------------------------------------

def draws_in_block(code: int, n: int, blk: int, n_sims: int) -> np.ndarray:
    """How many of the ``n`` draws of each simulation fall on block ``blk`` of ``n`` values."""
    count, lo, hi = np.full(n_sims, n, np.int64), 0, -(-n // BLOCK)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        size = min(hi * BLOCK, n) - lo * BLOCK
        # The same node gives the same split in every task that passes it.
        left = np.random.Generator(np.random.Philox(key=[code, lo << 32 | hi])).binomial(count, (mid - lo) * BLOCK / size)
        count, lo, hi = (left, lo, mid) if blk < mid else (count - left, mid, hi)
    return count


def block_sums(xs: np.ndarray, count: np.ndarray, code: int, blk: int) -> np.ndarray:
    """For each simulation of its draws in a block: sum, sum of squares, how many are positive, sum of these, and of the negative ones."""
    rng = np.random.Generator(np.random.Philox(key=[code ^ 0x5DEECE66D, blk]))
    out = np.zeros((5, len(count)))
    per = max(1, BUFFER // max(1, int(count.max())))
    for at in range(0, len(count), per):
        part = count[at:at + per]
        sim = np.repeat(np.arange(len(part)), part)
        x = xs[rng.integers(0, len(xs), len(sim))]
        for row, w in zip(out, (x, x * x, (x > 0).astype(float), np.maximum(x, 0.0), np.minimum(x, 0.0))):
            row[at:at + per] = np.bincount(sim, w, len(part))
    return out


SUMS = ("s", "q", "pos", "up", "dn")


def _summed(batches: Iterator[pa.RecordBatch], keys: Sequence[str], n_sims: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            code, n, blk = (batch.column(c)[row].as_py() for c in ("code", "n", "blk"))
            sums = block_sums(batch.column("xs")[row].values.to_numpy(), draws_in_block(code, n, blk, n_sims), code, blk)
            yield pa.RecordBatch.from_arrays([*_repeated(batch, row, keys, n_sims), pa.array(np.arange(n_sims)), pa.array(np.full(n_sims, n)), *map(pa.array, sums)], names=[*keys, "sim", "n", *SUMS])


def bootstrap_sums(blocks: DataFrame, keys: Sequence[str], n_sims: int) -> DataFrame:
    """(keys, sim, n, mean, sd, win_rate, profit_factor) of n draws with replacement a simulation, by numbers of draws per block."""
    keys = list(keys)
    d = _dealt(blocks, *keys, "blk").mapInArrow(lambda it: _summed(it, keys, n_sims), f"{_kinds(blocks, keys)}, sim long, n long, " + ", ".join(f"{c} double" for c in SUMS))
    d = d.groupBy(*keys, "sim", "n").agg(*[F.sum(c).alias(c) for c in SUMS])
    mean = F.col("s") / F.col("n")
    return d.select(*keys, "sim", "n", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))).alias("sd"),
                    (F.col("pos") / F.col("n")).alias("win_rate"), F.when(F.col("dn") < 0, -F.col("up") / F.nullif("dn", F.lit(0.0))).alias("profit_factor"))


# --- paths: segments of steps ------------------------------------------------------------------------

def _parts(rows: int, width: int) -> list[slice]:
    """Runs of rows that hold at most ``BUFFER`` numbers, or one row."""
    per = max(1, BUFFER // max(1, width))
    return [slice(at, min(at + per, rows)) for at in range(0, rows, per)]


def _values(path: str, mark: str, together: int) -> Iterator[np.ndarray]:
    """The values of a key in order, so many at a time, from the table of blocks in the shared folder (see ``simulated_paths``)."""
    held, size = [], 0
    scanner = _table(path).scanner(columns=["xs"], filter=ds.field("mark") == mark, batch_size=max(1, together // BLOCK), use_threads=False)
    for batch in scanner.to_batches():
        held.append(batch.column(0).flatten().to_numpy())
        size += len(held[-1])
        if size >= together:
            yield np.concatenate(held)
            held, size = [], 0
    if size:
        yield np.concatenate(held)


@lru_cache(maxsize=2)
def _table(path: str) -> ds.Dataset:
    """Files of the table in the order of their ranges."""
    fs, at = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    files = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(at)) if f.path.endswith(".parquet"))
    return ds.dataset(files, filesystem=fs, format="parquet")


def _tile(path: str, mark: str, n: int, how: str, code: int, sims: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """What each of the simulations draws at each of the steps."""
    place = np.empty((len(sims), len(steps)), np.uint32 if n < 1 << 32 else np.int64)
    wide = min(NEAR, len(steps))
    deep = max(1, NEAR // wide)
    for rows in (slice(at, at + deep) for at in range(0, len(sims), deep)):
        for at in range(0, len(steps), wide):
            place[rows, at:at + wide] = DRAWS[how](code, sims[rows], steps[at:at + wide], n)
    x, base = np.empty(place.shape), 0
    for xs in _values(path, mark, TOGETHER):
        for part in _parts(*place.shape):
            if len(xs) == n:
                xs.take(place[part], out=x[part], mode="clip")  # places lie inside
            else:
                here = (place[part] >= base) & (place[part] < base + len(xs))
                x[part][here] = xs[place[part][here] - base]
        base += len(xs)
    if base != n:
        raise ValueError(f"{base} of {n} values of {mark} found")
    return x


def _walks(batches, keys, how, n_sims, steps, path, capital) -> Iterator[pa.RecordBatch]:
    """Simulations from their first step to their last: a tile of steps after another, so that each draw is made once."""
    for batch in batches:
        for row in range(batch.num_rows):
            code, n, mark, first = (batch.column(c)[row].as_py() for c in ("code", "n", "mark", "first"))
            sims = np.arange(first, min(first + TOGETHER_SIMS, n_sims))
            total, pos, up, dn = np.zeros((4, len(sims)))
            peak, worst = np.full(len(sims), capital), np.full(len(sims), np.inf)
            wide = steps or max(16, HELD // len(sims))
            for begin in range(0, n, wide):
                tile = _tile(path, mark, n, how, code, sims, np.arange(begin, min(begin + wide, n)))
                strip = max(1, NEAR // len(sims))
                for at in range(0, tile.shape[1], strip):
                    x = tile[:, at:at + strip]
                    pos += (x > 0).sum(axis=1)
                    up += np.maximum(x, 0.0).sum(axis=1)
                    dn += np.minimum(x, 0.0).sum(axis=1)
                    equity = np.cumsum(x, axis=1)
                    equity += total[:, None]
                    total = equity[:, -1].copy()
                    equity += capital
                    top = np.maximum.accumulate(equity, axis=1)
                    np.maximum(top, peak[:, None], out=top)
                    peak = top[:, -1].copy()
                    equity -= top
                    top[top == 0] = 1.0
                    equity /= top
                    np.minimum(worst, equity.min(axis=1), out=worst)
            columns = [pa.array(sims), pa.array(np.full(len(sims), n)), *map(pa.array, (total, worst, pos, up, dn))]
            yield pa.RecordBatch.from_arrays([*_repeated(batch, row, keys, len(sims)), *columns], names=[*keys, "sim", "n", "total", "dd", "pos", "up", "dn"])


@dataclass
class _Segment:
    """One stretch of steps of all simulations."""

    keys: list
    n: int
    seg: int
    x: np.ndarray
    before: np.ndarray | None  # of each simulation the equity that comes in


def _filled(batches: Iterator[pa.RecordBatch], keys: Sequence[str], how: str, n_sims: int, steps: int, path: str) -> Iterator[_Segment]:
    for batch in batches:
        for row in range(batch.num_rows):
            code, n, mark, k = (batch.column(c)[row].as_py() for c in ("code", "n", "mark", "seg"))
            before = batch.column("xs")[row].values.to_numpy() if "xs" in batch.schema.names else None
            x = _tile(path, mark, n, how, code, np.arange(n_sims), np.arange(k * steps, min(n, (k + 1) * steps)))
            yield _Segment(_repeated(batch, row, keys, 1), n, k, x, before)


def _of(seg: _Segment, times: int) -> list[pa.Array]:
    return [k.take(pa.array(np.zeros(times, np.int64))) for k in seg.keys]


SEGMENT = ("total", "m2", "steps")


def _totals(batches, keys, how, n_sims, steps, path) -> Iterator[pa.RecordBatch]:
    for seg in _filled(batches, keys, how, n_sims, steps, path):
        sums = np.empty((len(SEGMENT), n_sims))
        for part in _parts(*seg.x.shape):
            x = seg.x[part]
            off = x - x[:, :1]  # equal values have no spread at all, whatever their mean rounds to
            off -= off.mean(axis=1, keepdims=True)
            sums[:, part] = x.sum(axis=1), (off * off).sum(axis=1), np.full(len(x), x.shape[1])
        yield pa.RecordBatch.from_arrays([*_of(seg, n_sims), pa.array(np.full(n_sims, seg.seg)), pa.array(np.full(n_sims, seg.n)), pa.array(np.arange(n_sims)), *map(pa.array, sums)], names=[*keys, "seg", "n", "sim", *SEGMENT])


def _fans(batches, keys, how, n_sims, steps, path, ranks) -> Iterator[pa.RecordBatch]:
    for seg in _filled(batches, keys, how, n_sims, steps, path):
        for part in _parts(*seg.x.shape):
            np.cumsum(seg.x[part], axis=1, out=seg.x[part])
            seg.x[part] += seg.before[part, None]
        for part in _parts(*seg.x.shape[::-1]):
            equity = np.partition(np.ascontiguousarray(seg.x[:, part].T), ranks, axis=1)
            draws = seg.seg * steps + np.arange(part.start, part.stop) + 1
            yield pa.RecordBatch.from_arrays([*_of(seg, len(draws)), pa.array(draws), *[pa.array(equity[:, r]) for r in ranks]], names=[*keys, "draw", *[f"r{k}" for k in range(len(ranks))]])


@dataclass(frozen=True)
class Paths:
    """Simulated equity paths over ``blocks`` (see ``value_blocks``): n steps each, from ``capital``."""

    blocks: DataFrame
    keys: tuple[str, ...]
    n_sims: int
    capital: float
    how: str
    steps: int | None  # of a tile; by default as many as ``HELD`` allows
    path: str  # of the values by key and place, as files that tasks read for themselves

    @cached_property
    def _each(self) -> DataFrame:
        """(keys, code, n, mark), a row a key."""
        d = self.blocks.groupBy(*self.keys).agg(F.first("code").alias("code"), F.first("n").alias("n"))
        return d.withColumn("mark", F.to_json(F.struct(*self.keys)))

    @property
    def _wide(self) -> int:
        return self.steps or max(16, HELD // self.n_sims)

    def _segments(self) -> DataFrame:
        return self._each.withColumn("seg", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / self._wide))))

    @cached_property
    def totals(self) -> DataFrame:
        """(keys, seg, n, sim, sums), written once."""
        keys, how, n_sims, steps, path = list(self.keys), self.how, self.n_sims, self._wide, self.path
        schema = f"{_kinds(self.blocks, keys)}, seg long, n long, sim long, " + ", ".join(f"{c} double" for c in SEGMENT)
        return cut(_dealt(self._segments(), *keys, "seg").mapInArrow(lambda it: _totals(it, keys, how, n_sims, steps, path), schema))

    def _carried(self) -> DataFrame:
        """Equity of every simulation before each segment."""
        w = Window.partitionBy(*self.keys, "sim").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
        return self.totals.withColumn("start", F.coalesce(F.sum("total").over(w), F.lit(0.0)) + self.capital)

    def _second(self, work: Callable, schema: str) -> DataFrame:
        """``work`` over the segments once more, each with what is carried into it."""
        state = F.array_sort(F.collect_list(F.struct("sim", "start")))
        carried = self._carried().groupBy(*self.keys, "seg").agg(state.alias("c"))
        d = self._segments().join(carried.select(*self.keys, "seg", F.col("c.start").alias("xs")), [*self.keys, "seg"])
        return _dealt(d, *self.keys, "seg").mapInArrow(work, schema)

    def summary(self) -> DataFrame:
        """(keys, sim, final_equity, max_dd_pct, mean, win_rate, profit_factor)."""
        keys, how, n_sims, steps, path, capital = list(self.keys), self.how, self.n_sims, self.steps, self.path, self.capital
        d = self._each.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(n_sims - 1), F.lit(TOGETHER_SIMS))))
        schema = f"{_kinds(self.blocks, keys)}, sim long, n long, total double, dd double, pos double, up double, dn double"
        d = _dealt(d, *keys, "first").mapInArrow(lambda it: _walks(it, keys, how, n_sims, steps, path, capital), schema)
        return d.select(*keys, "sim", (F.col("total") + self.capital).alias("final_equity"), F.col("dd").alias("max_dd_pct"), (F.col("total") / F.col("n")).alias("mean"), (F.col("pos") / F.col("n")).alias("win_rate"),
                        F.when(F.col("dn") < 0, -F.col("up") / F.nullif("dn", F.lit(0.0))).alias("profit_factor"))

    def moments(self) -> DataFrame:
        """(keys, sim, n, mean, sd) of the values drawn; what lies between segments is added to the spread inside them."""
        d = self.totals.groupBy(*self.keys, "sim", "n").agg(F.sum("total").alias("s"), F.sum("m2").alias("m2"), F.sum(F.col("total") * F.col("total") / F.col("steps")).alias("q"))
        spread = F.greatest(F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.lit(0.0))
        return d.select(*self.keys, "sim", "n", (F.col("s") / F.col("n")).alias("mean"), F.sqrt((F.col("m2") + spread) / F.col("n")).alias("sd"))

    def fan(self, percentiles: Sequence[int] = (5, 25, 50, 75, 95)) -> DataFrame:
        """Nearest-rank equity percentiles across the simulations after every draw."""
        keys, how, n_sims, steps, path = list(self.keys), self.how, self.n_sims, self._wide, self.path
        ranks = [max(0, round(p / 100 * (n_sims - 1))) for p in percentiles]
        d = self._second(lambda it: _fans(it, keys, how, n_sims, steps, path, ranks), f"{_kinds(self.blocks, keys)}, draw long, " + ", ".join(f"r{k} double" for k in range(len(ranks))))
        return d.select(*keys, "draw", *[F.col(f"r{k}").alias(f"p{p}") for k, p in enumerate(percentiles)])


def simulated_paths(blocks: DataFrame, keys: Sequence[str], n_sims: int, capital: float, how: str = "bootstrap", steps: int | None = None) -> Paths:
    """Paths of as many draws as there are values: with replacement, or (``how="shuffle"``) each value once in random order.

    The values are written once to the shared folder, by key and place; tasks stream them from there, a bounded number at
    a time, so they are not shuffled to the segments that draw from them.
    """
    keys = list(keys)
    d = blocks.select(F.to_json(F.struct(*keys)).alias("mark"), "blk", "xs")
    path = kept(d.repartitionByRange("mark", "blk").sortWithinPartitions("mark", "blk"))
    return Paths(blocks, tuple(keys), n_sims, float(capital), how, steps, path)


# --- statistics over simulations ---------------------------------------------------------------------

def bootstrap_pvalue(summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    return summary.groupBy(*keys).agg(F.avg((F.col("mean") <= 0).cast("double")).alias("p_value"))


def confidence_intervals(summary: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """2.5% and 97.5% percentiles over the simulations (one value per simulation).

    Simulations where a metric is undefined (NULL or NaN) are left out. Without any other both bounds are 0, of the
    profit factor also with a single one.
    """
    def q(m: str, p: float, n: str) -> Column:
        known = F.when(~F.isnan(m), F.col(m).cast("double"))
        return F.when(F.count(known) >= (2 if m == "profit_factor" else 1), F.percentile(known, F.lit(p))).otherwise(0.0).alias(f"{m}_{n}")

    return summary.groupBy(*keys).agg(*[c for m in metrics for c in (q(m, 0.025, "lo"), q(m, 0.975, "hi"))])


def annual_sharpe(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Annualised Sharpe of each simulation of daily values; NULL when constant."""
    return sums.select(*keys, "sim", F.when(F.col("sd") > 0, F.col("mean") / F.nullif("sd", F.lit(0.0)) * F.sqrt(F.lit(252.0))).alias("sharpe"))


def _sharpe(n: np.ndarray, s: np.ndarray, q: np.ndarray) -> np.ndarray:
    m = np.maximum(n, 1)
    mean = s / m
    sd = np.sqrt(np.maximum(q / m - mean * mean, 0.0))
    return np.where((n >= 2) & (sd > 1e-12), mean / np.where(sd > 0, sd, 1.0) * np.sqrt(252.0), 0.0)


PERMUTATIONS = 256  # of a task
TIE = 1e-9  # gains this near are equal: the same days summed in another order, or other days of equal sums


def permuted_gains(days: np.ndarray, ok: np.ndarray, perms: np.ndarray, code: int) -> np.ndarray:
    """Sharpe gain of the allowed days under each permutation of their labels; ``days``: rows (n, s, q) by date."""
    keep = ok[np.argsort(hashed(code, perms, np.arange(len(ok))), axis=1, kind="stable")].astype(float)
    return _sharpe(*(keep @ days).T) - _sharpe(*days.sum(axis=0))


def permutation_test(trades: DataFrame, labels: DataFrame, keys: Sequence[str], allowed: Sequence[int], n_perm: int = 5000, date: str = "date", value: str = "x", seed: int = 42) -> DataFrame:
    """Sharpe gain of trading only the allowed regimes against shuffled day labels.

    A permutation that only rounding sets apart from the actual labels counts as no worse, so labels that allow all days
    have a p-value of 1. Trades are summed per day first. A day is at most one row a key, so a key's days are a bounded array, which is sent
    once to each task of ``PERMUTATIONS`` permutations.
    """
    keys = list(keys)
    v = F.col(value)
    days = trades.groupBy(*keys, date).agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    days = days.join(labels.select(F.col("date").alias(date), "label"), date, "left").withColumn("ok", F.coalesce("label", F.lit(1)).isin(*allowed))
    row = F.struct(F.col(date).alias("d"), F.col("n").cast("double").alias("n"), "s", "q", "ok")
    d = days.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("days")).withColumn("code", hash_long(F.lit(seed), *[F.col(k) for k in keys]))
    d = d.select(*keys, "code", *[F.col(f"days.{c}").alias(c) for c in ("n", "s", "q", "ok")], F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1), F.lit(PERMUTATIONS))).alias("first"))
    d = _dealt(d, *keys, "first")

    def gains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[keys].copy()
            actual, above, total = [], [], []
            for r in pdf.itertuples(index=False):
                table, ok = np.stack([np.asarray(c, float) for c in (r.n, r.s, r.q)], axis=1), np.asarray(r.ok, bool)
                real = _sharpe(*table[ok].sum(axis=0)) - _sharpe(*table.sum(axis=0))
                gain = permuted_gains(table, ok, np.arange(r.first, min(r.first + PERMUTATIONS, n_perm)), r.code)
                actual.append(float(real))
                above.append(int((gain >= real - TIE).sum()))
                total.append(float(gain.sum()))
            yield out.assign(actual_gain=actual, above=above, total=total)

    g = d.mapInPandas(gains, f"{_kinds(d, keys)}, actual_gain double, above long, total double")
    return g.groupBy(*keys).agg((F.sum("above") / n_perm).alias("p_value"), F.first("actual_gain").alias("actual_gain"), (F.sum("total") / n_perm).alias("mean_gain"))


def block_positions(codes: tuple[int, int], sims: np.ndarray, n: int, mean_block: float) -> tuple[np.ndarray, np.ndarray]:
    """For each simulation and step the step its block starts at and the position it draws, circular over ``n``."""
    steps = np.arange(n)
    breaks = (steps == 0) | (hashed(codes[0], sims, steps) / 2.0**53 < 1.0 / max(mean_block, 1.0))
    at = np.maximum.accumulate(np.where(breaks, steps, 0), axis=1)
    start = np.take_along_axis(with_replacement(codes[1], sims, steps, n), at, axis=1)
    return at, (start + steps - at) % n


def block_bootstrap(days: DataFrame, keys: Sequence[str], date: str, n_sims: int, mean_block: float, seed: int = 42) -> DataFrame:
    """Stationary bootstrap of day positions: geometric blocks, circular; shared by everything joined to it.

    One row per (sim, step) with ``pos`` in 0..n-1 and the step its block starts at; the horizon is the number of days (a
    key has at most one row a day). Only numbers of days are shuffled.
    """
    keys = list(keys)
    n = days.groupBy(*keys).agg(F.count(F.col(date)).alias("n")).where("n > 0")
    n = n.withColumns({"brk": hash_long(F.lit(seed), F.lit("break")), "start": hash_long(F.lit(seed), F.lit("start"))})
    per = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(BUFFER) / F.col("n")))
    tasks = n.withColumn("per", per).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_sims - 1).cast("long"), F.col("per"))))

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                size, brk, start, each, first = (batch.column(c)[row].as_py() for c in ("n", "brk", "start", "per", "first"))
                sims = np.arange(first, min(first + each, n_sims))
                at, pos = block_positions((brk, start), sims, size, mean_block)
                for k in range(len(sims)):
                    yield pa.RecordBatch.from_arrays([*_repeated(batch, row, keys, size), pa.array(np.full(size, sims[k])), pa.array(np.arange(size)), pa.array(at[k]), pa.array(pos[k])], names=[*keys, "sim", "step", "block_start", "pos"])

    return _dealt(tasks, *keys, "first").mapInArrow(drawn, f"{_kinds(days, keys)}, sim long, step long, block_start long, pos long")


def daily_r_matrix(trades: DataFrame, calendar: DataFrame, slots: Sequence, slot: str, risk: float, commission: float, cap_daily: bool = False) -> DataFrame:
    """Dense (slot, day) table: sum of R, mean stop, count, fired flag and dollars net of commission."""
    dense = calendar.withColumn(slot, F.explode(F.array(*[F.lit(s) for s in slots])))
    g = trades.groupBy(slot, "date").agg(F.sum("r").alias("sum_r"), F.avg("sl_distance").alias("mean_sl"), F.count(F.lit(1)).alias("n"))
    d = dense.join(g, [slot, "date"], "left").fillna(0, subset=["sum_r", "n"])
    gross = F.col("sum_r") * risk / (F.greatest(F.col("n"), F.lit(1)) if cap_daily else F.lit(1.0))
    return d.withColumns({"fired": F.col("n") > 0, "dollars": F.when(F.col("n") > 0, gross - F.col("n") * commission).otherwise(0.0)})


