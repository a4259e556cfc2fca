"""Bar hygiene: duplicates, gaps, anomalies, partial bars."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalar import minute_of_day
from barloom.operators.bars import SYM
from barloom.operators.scan import framed

MAX_RANGE = 200.0


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """First row per key in ingestion order, combined map-side so copies of one key never pile up."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return first.select(*keys, "__r.*").select(*df.columns)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return last.select(*keys, "__r.*").select(*df.columns)


def anomaly_rules() -> dict[str, Column]:
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return {
        "zero_volume": F.col("volume") == 0,
        "zero_range": h == l,
        "extreme_range": h - l > MAX_RANGE,
        "invalid_ohlc": (h < o) | (h < c) | (l > o) | (l > c),
    }


def flag_anomalous(bars: DataFrame) -> DataFrame:
    flag = F.lit(False)
    for rule in anomaly_rules().values():
        flag = flag | F.coalesce(rule, F.lit(False))
    return bars.withColumn("anomalous", flag)


def gap_size(prev_ts: Column, ts: Column, minutes: int) -> Column:
    """Bucket of the gap behind a bar; NULL without a gap, over maintenance, or after a Friday bar."""
    secs = F.unix_timestamp(ts.cast("timestamp")) - F.unix_timestamp(prev_ts.cast("timestamp"))
    whole = F.floor(secs / 60)
    prev_min = minute_of_day(prev_ts)
    excluded = prev_min.between(955, 1085) | (F.weekday(prev_ts) == 4)
    return F.when((secs > minutes * 60) & ~excluded, F.when(whole <= 5, "minor").when(whole <= 360, "session").otherwise("large"))


def detect_gaps(bars: DataFrame, minutes: int, keys: Sequence[str] = SYM) -> DataFrame:
    def add(d, w):
        return d.withColumn("prev_ts", F.lag("ts").over(w)).withColumn("gap", gap_size(F.col("prev_ts"), F.col("ts"), minutes))

    return framed(bars, keys, ["ts"], add, before=1)


def trim_partial(bars: DataFrame, minutes: int, keys: Sequence[str] = SYM) -> DataFrame:
    """Drop a series' first bar when it starts off the bar grid."""
    if minutes <= 1:
        return bars
    first = bars.groupBy(*keys).agg(F.min("ts").alias("__first"))
    off_grid = (F.col("ts") == F.col("__first")) & (F.minute("ts") % minutes != 0)
    return bars.join(first, list(keys), "left").where(~F.coalesce(off_grid, F.lit(False))).drop("__first")


def cleaning_report(raw: DataFrame, minutes: int, keys: Sequence[str] = SYM) -> DataFrame:
    """Per key: duplicates removed, gaps by size, anomalous bars by rule."""
    total = raw.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_in"))
    bars = keep_first(raw, [*keys, "ts"], ["ingest_id"])
    rules = anomaly_rules()
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    rep = flag_anomalous(detect_gaps(bars, minutes, keys)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows_out"),
        *[count(F.col("gap") == g).alias(f"gaps_{g}") for g in ("minor", "session", "large")],
        *[count(r).alias(n) for n, r in rules.items()], count(F.col("anomalous")).alias("anomalous"))
    return total.join(rep, list(keys)).withColumn("duplicates", F.col("rows_in") - F.col("rows_out"))
