"""Ranking, sampling, set operations and fingerprints."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalar import div, hash_long, minute_of_day
from barloom.operators.bars import session_tag
from barloom.operators.clean import keep_first
from barloom.operators.scan import with_ordinal


def except_configs(new: DataFrame, stored: DataFrame, on: Sequence[str]) -> DataFrame:
    return new.select(*on).distinct().join(stored.select(*on).distinct(), list(on), "left_anti")


def ranked(df: DataFrame, order: Sequence[Column], out: str = "pos") -> DataFrame:
    """Position in a total order of an already aggregated result (a grid, not raw rows)."""
    return df.withColumn(out, F.row_number().over(Window.orderBy(*order)))


def top_n_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First k rows per group (0 keeps all); ranks are filtered early inside each partition."""
    if k == 0:
        return df
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("__rn") <= k).drop("__rn")


def sample_points(df: DataFrame, ident: str, n: int, seed: int = 0) -> DataFrame:
    """n rows chosen by a seeded hash: the same sample on every run."""
    return df.orderBy(hash_long(F.lit(seed), F.col(ident)), ident).limit(n)


def daily_signal_cap(signals: DataFrame, keys: Sequence[str], per_day: int | None = None, per_side: int | None = None, per_hours: tuple[int, int] | None = None, ts: str = "ts") -> DataFrame:
    """Keep the first k signals per day, per side and per n-hour bucket."""
    day, d = F.to_date(ts), signals
    if per_side:
        d = top_n_per_group(d.withColumn("__d", day), [*keys, "__d", "direction"], [F.col(ts)], per_side).drop("__d")
    if per_hours:
        hours, k = per_hours
        d = top_n_per_group(d.withColumn("__d", day).withColumn("__b", F.floor(F.hour(ts) / hours)), [*keys, "__d", "__b"], [F.col(ts)], k).drop("__d", "__b")
    if per_day:
        d = top_n_per_group(d.withColumn("__d", day), [*keys, "__d"], [F.col(ts)], per_day).drop("__d")
    return d


def dedup_levels(levels: DataFrame, keys: Sequence[str], price: str, order: Sequence) -> DataFrame:
    """One level per (price in cents, direction); the first in order wins."""
    d = levels.withColumn("__p", F.bround(price, 2))
    return keep_first(d, [*keys, "__p", "direction"], order).drop("__p")


def sl_coverage(trades: DataFrame, by: Sequence[str]) -> DataFrame:
    return trades.groupBy(*by).agg(F.avg(F.col("sl_price").isNotNull().cast("double")).alias("coverage"))


def filter_meta(trades: DataFrame, bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Minutes into the session and the share of the target distance that lies before the fair price."""
    keys = list(keys)
    fair = bars.groupBy(*keys, F.to_date("ts").alias("__d"), session_tag().alias("session")).agg(F.min_by("open", "ts").alias("__fair"))
    t = trades.withColumns({"__d": F.to_date("entry_ts"), "session": session_tag("entry_ts")}).join(fair, [*keys, "__d", "session"], "left")
    s, e, tp, f = F.col("session"), F.col("entry_price"), F.col("initial_tp_price"), F.col("__fair")
    start = F.when(s == "ASIA", 1200).when(s == "LONDON", 120).when(s == "NY", 570)
    # Prices are compared as they are: a NaN counts as the largest number, where a difference with it would be above 0 both ways.
    up, down = (F.col("direction") == 1) & (e < f) & (tp > f), (F.col("direction") == -1) & (e > f) & (tp < f)
    inside = (s != "OFF") & (up | down)
    return t.withColumns({
        "elapsed": F.coalesce(minute_of_day("entry_ts") - start, F.lit(0)),
        "beyond": F.coalesce(F.when(inside, div(F.abs(f - e), F.abs(tp - e))), F.lit(float("inf")))}).drop("__d", "__fair")


def record_digest(columns: Sequence[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)


RANGE = 4096  # records whose digests are digested together


def ordered_digest(records: DataFrame, by: Sequence[str], digest: str, order: str, block: Column | None = None, size: int = RANGE) -> DataFrame:
    """SHA-256 over the SHA-256 of each ``size`` record digests of a group in order; no buffer holds a group's records.

    ``block``: monotone in ``order``, with a bounded number of records each (by default 65,536 consecutive numbers).
    """
    d = records.select(*by, order, F.col(digest).alias("__h"))
    d = with_ordinal(d, list(by), [order], F.floor(F.col(order) / 65536) if block is None else block, "__k")
    joined = lambda at: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, "__h"))), lambda x: x["__h"]), ""), 256)
    ranges = d.groupBy(*by, F.floor((F.col("__k") - 1) / size).alias("__r")).agg(F.count(F.lit(1)).alias("n"), joined("__k").alias("__h"))
    return ranges.groupBy(*by).agg(F.sum("n").alias("n"), joined("__r").alias("digest"))


def fingerprint(trades: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Order-free fingerprint of a trade set: count and combined record hashes (parts of their MD5) per group."""
    bits = lambda first, n: F.conv(F.substring(F.md5(F.to_json(F.struct(*columns))), first, n), 16, 10).cast("bigint")
    return trades.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(bits(1, 12)).alias("xor_hash"), F.sum(bits(13, 8)).alias("sum_hash"))


def first_difference(a: DataFrame, b: DataFrame, order: Sequence[str]) -> DataFrame:
    """Records present on one side only, the earliest first."""
    cols = a.columns
    left = a.exceptAll(b.select(*cols)).withColumn("side", F.lit("expected"))
    right = b.select(*cols).exceptAll(a).withColumn("side", F.lit("actual"))
    return left.unionByName(right).orderBy(*order).limit(1)
