"""One position at a time, for every score threshold at once.

Whether a trade is taken depends on the exit of the trade taken before it, and on nothing else. Trades in order are cut
into blocks; inside a block every trade knows the chain of trades that follows once it is taken, and so the exit with which
the chain leaves the block. As chains soon meet, this is a short step function from the exit that comes in to the one
that goes out. Small rows of steps, one a block and threshold, are composed in order; then all blocks pick their trades at
the same time. A block is read once for all thresholds, and no task holds or walks more than blocks and steps.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.scan import with_ordinal
from barloom.session import cut

BLOCK = 4096
LEAST_TRADES, LEAST_PER_DAY = 5, 0.1
NEVER = -(1 << 62)


def _number(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType.simpleString()
    c = F.col(name)
    return F.unix_micros(c.cast("timestamp")) if kind.startswith("timestamp") else F.datediff(c, F.lit("1970-01-01").cast("date")).cast("long") if kind == "date" else c.cast("long")


def _chains(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each trade, if taken, the next one that is (its number, len: none), and the exit of the last one of the chain."""
    n = len(start)
    after = np.maximum(np.searchsorted(start, end, side="right"), np.arange(n) + 1)
    last = np.where(after < n, after, np.arange(n))
    while True:
        further = last[last]
        if (further == last).all():
            return after, end[last]
        last = further


def block_steps(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(below, out): who comes in with an exit before ``below[k]``, the first such k, leaves with ``out[k]``; at or above all: as before."""
    if not len(start):
        return start, end
    _, out = _chains(start, end)
    ends = np.append(np.flatnonzero(out[1:] != out[:-1]), len(out) - 1)
    return start[ends], out[ends]


def taken_in_block(start: np.ndarray, end: np.ndarray, until: int) -> np.ndarray:
    """Numbers of the trades that are taken after a position that ends at ``until``."""
    after, at, found = np.maximum(np.searchsorted(start, end, side="right"), np.arange(len(start)) + 1), int(np.searchsorted(start, until, side="right")), []
    while at < len(start):
        found.append(at)
        at = int(after[at])
    return np.array(found, np.int64)


def _arrays(batch: pa.RecordBatch, row: int, names: Sequence[str]) -> list[np.ndarray]:
    return [batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in names]


def _same(batch: pa.RecordBatch, row: int, keys: Sequence[str], times: int) -> list[pa.Array]:
    return [batch.column(k).take(pa.array(np.full(times, row, np.int64))) for k in keys]


def _open(score: np.ndarray, level: float | None) -> np.ndarray:
    return np.arange(len(score)) if level is None else np.flatnonzero(score > level)


def _stepped(batches: Iterator[pa.RecordBatch], keys: Sequence[str], levels: Sequence[float | None]) -> Iterator[pa.RecordBatch]:
    longs = pa.list_(pa.int64())
    for batch in batches:
        for row in range(batch.num_rows):
            start, end, score = _arrays(batch, row, ("starts", "ends", "scores"))
            steps = [block_steps(start[at], end[at]) for at in (_open(score, x) for x in levels)]
            blk = batch.column("blk")[row].as_py()
            yield pa.RecordBatch.from_arrays(
                [*_same(batch, row, keys, len(levels)), pa.array(np.full(len(levels), blk)), pa.array(range(len(levels)), pa.int32()), pa.array([b.tolist() for b, _ in steps], longs), pa.array([o.tolist() for _, o in steps], longs)],
                names=[*keys, "blk", "level", "below", "out"])


def _composed(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Rows of one key and threshold come block by block; each leaves with the exit that comes into its block."""
    now, until = None, NEVER
    for batch in batches:
        marks, came = list(zip(batch.column("level").to_pylist(), *[batch.column(k).to_pylist() for k in keys])), []
        for row, mark in enumerate(marks):
            if mark != now:
                now, until = mark, NEVER
            came.append(until)
            below, out = _arrays(batch, row, ("below", "out"))
            k = int(np.searchsorted(below, until, side="right"))
            if k < len(below):
                until = int(out[k])
        yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], batch.column("blk"), batch.column("level"), pa.array(came, pa.int64())], names=[*keys, "blk", "level", "until"])


def _kinds(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in names)


def best_per_start(df: DataFrame, keys: Sequence[str], start: str, score: str, ident: str) -> DataFrame:
    """Of trades that start together the one with the best score (ties: the smallest id), in order as ``__ord``; written once."""
    rest = [c for c in df.columns if c not in (*keys, start)]
    one = df.groupBy(*keys, start).agg(F.max_by(F.struct(*rest), F.struct(F.col(score), (-F.col(ident)).alias("__i"))).alias("__r")).select(*keys, start, "__r.*")
    return cut(with_ordinal(one, list(keys), [start], F.floor(_number(one, start) / 86_400_000_000) if one.schema[start].dataType.simpleString().startswith("timestamp") else F.floor(_number(one, start) / 1024), "__ord"))


def entries_of_blocks(one: DataFrame, keys: Sequence[str], start: str, end: str, score: str, levels: Sequence[float | None], values: dict[str, Column]) -> DataFrame:
    """Blocks of ``one`` with ``untils``: of every level the exit that comes in. ``values`` ride along as arrays."""
    keys = list(keys)
    item = F.struct(F.col("__ord").alias("o"), _number(one, start).alias("s"), F.coalesce(_number(one, end), _number(one, start)).alias("e"), F.col(score).cast("double").alias("p"), *[c.cast("double").alias(n) for n, c in values.items()])
    blocks = one.groupBy(*keys, F.floor((F.col("__ord") - 1) / BLOCK).alias("blk")).agg(F.array_sort(F.collect_list(item)).alias("b"))
    blocks = cut(blocks.select(*keys, "blk", F.col("b.o").alias("ords"), F.col("b.s").alias("starts"), F.col("b.e").alias("ends"), F.col("b.p").alias("scores"), *[F.col(f"b.{n}").alias(n) for n in values]))
    kinds = _kinds(blocks, keys)
    n = int(one.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = blocks.repartition(n, *keys, "blk").mapInArrow(lambda it: _stepped(it, keys, levels), f"{kinds}, blk long, level int, below array<long>, out array<long>")
    order = [*keys, "level"]
    came = steps.repartition(n, *order).sortWithinPartitions(*order, "blk").mapInArrow(lambda it: _composed(it, keys), f"{kinds}, blk long, level int, until long")
    untils = came.groupBy(*keys, "blk").agg(F.array_sort(F.collect_list(F.struct("level", "until"))).alias("u")).select(*keys, "blk", F.col("u.until").alias("untils"))
    return blocks.join(untils, [*keys, "blk"])


def greedy_non_overlap(df: DataFrame, keys: Sequence[str], start: str, end: str, score: str, ident: str) -> DataFrame:
    """One position at a time: best score per start, skipping starts inside (or at the end of) the position just taken."""
    keys = list(keys)
    one = best_per_start(df, keys, start, score, ident)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                s, e, o, until = _arrays(batch, row, ("starts", "ends", "ords", "untils"))
                at = taken_in_block(s, e, int(until[0]))
                yield pa.RecordBatch.from_arrays([*_same(batch, row, keys, len(at)), pa.array(o[at])], names=[*keys, "__ord"])

    blocks = entries_of_blocks(one, keys, start, end, score, [None], {})
    taken = blocks.mapInArrow(pick, f"{_kinds(blocks, keys)}, __ord long")
    return one.join(taken, [*keys, "__ord"], "left_semi").drop("__ord")


def threshold_sweep_selection(df: DataFrame, keys: Sequence[str], thresholds: Sequence[float], start: str, end: str, ident: str, score: str = "pred", r: str = "r", risk: str | None = None, p_high: str | None = None, n_days: int | None = None) -> DataFrame:
    """Non-overlapping selection at each threshold (strictly above): n, total_r, win_rate; points (R times ``risk``), usable, tpd, n_high.

    A threshold is usable with at least ``LEAST_TRADES`` trades; its trades a day are then n over ``n_days`` (by default the
    calendar days on which the key has trades), at least ``LEAST_PER_DAY``, else 0. ``n_high``: trades taken where ``p_high`` exceeds a half.
    """
    keys, levels = list(keys), [float(t) for t in thresholds]
    one = best_per_start(df, keys, start, score, ident)
    values = {"r": F.col(r), "points": F.col(r) * (F.lit(1.0) if risk is None else F.col(risk)), "high": F.lit(0.0) if p_high is None else (F.col(p_high) > 0.5).cast("double")}

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                s, e, p, x, points, high, until = _arrays(batch, row, ("starts", "ends", "scores", "r", "points", "high", "untils"))
                sums = np.zeros((5, len(levels)))
                for k, level in enumerate(levels):
                    own = _open(p, level)
                    at = own[taken_in_block(s[own], e[own], int(until[k]))]
                    sums[:, k] = len(at), x[at].sum(), (x[at] > 0).sum(), points[at].sum(), np.nansum(high[at])
                yield pa.RecordBatch.from_arrays([*_same(batch, row, keys, len(levels)), pa.array(levels), *map(pa.array, sums)], names=[*keys, "threshold", "n", "r", "wins", "points", "high"])

    blocks = entries_of_blocks(one, keys, start, end, score, levels, values)
    sums = blocks.mapInArrow(add_up, f"{_kinds(blocks, keys)}, threshold double, n double, r double, wins double, points double, high double")
    d = sums.groupBy(*keys, "threshold").agg(*[F.sum(c).alias(c) for c in ("n", "r", "wins", "points", "high")]).where("n > 0")
    if n_days is None:
        d = d.join(df.groupBy(*keys).agg(F.count_distinct(F.to_date(start)).alias("__days")), keys)
    days = F.col("__days") if n_days is None else F.lit(n_days)
    usable = F.col("n") >= LEAST_TRADES
    return d.select(
        *keys, "threshold", F.col("n").cast("long").alias("n"), F.col("r").alias("total_r"), (F.col("wins") / F.col("n")).alias("win_rate"), "points", usable.alias("usable"),
        F.when(usable, F.greatest(F.lit(LEAST_PER_DAY), F.col("n") / F.greatest(days, F.lit(1)))).otherwise(0.0).alias("tpd"), F.col("high").cast("long").alias("n_high"))
