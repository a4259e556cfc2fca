"""Bar tables: resampling, calendars, sessions and levels."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalar import minute_of_day
from barloom.operators.scan import with_ordinal, day_of

SYM = ["symbol"]
RTH_OPEN, RTH_CLOSE = 570, 960
# Session windows as minutes of day [start, end).
SESSIONS = {
    "asia": (1200, 1440), "london": (120, 300), "ny_pre": (480, 570), "ny_am": (570, 660),
    "ny_lunch": (720, 780), "ny_pm": (810, 960),
}


def bar_start(ts: str, minutes: int, offset: int = 0) -> Column:
    return F.window(F.col(ts), f"{minutes} minutes", f"{minutes} minutes", f"{offset} minutes").start


def default_offset(minutes: int) -> int:
    """Bucket alignment: 09:30 is a boundary up to 30 minutes, 4-hour bars start at 02:00."""
    return 570 % minutes if minutes <= 30 else 120 if minutes == 240 else 0


def resample_ticks(ticks: DataFrame, minutes: int, keys: Sequence[str] = SYM, offset: int | None = None) -> DataFrame:
    """Ticks (ts, event_id, price) to bars; combined map-side before the only shuffle. Ticks without a price open and close none."""
    off = default_offset(minutes) if offset is None else offset
    at = F.when(F.col("price").isNotNull(), F.struct("ts", "event_id"))
    return (
        ticks.groupBy(*keys, bar_start("ts", minutes, off).alias("__bar"))
        .agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
             F.max_by("price", at).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
        .withColumnRenamed("__bar", "ts")
    )


def resample_ohlcv(bars: DataFrame, minutes: int, keys: Sequence[str] = SYM, offset: int | None = None) -> DataFrame:
    """Coarser bars; ``close_ts`` is the fine bar on which each one closes."""
    off = default_offset(minutes) if offset is None else offset
    extra = [F.max("anomalous").alias("anomalous")] if "anomalous" in bars.columns else []
    return (
        bars.groupBy(*keys, bar_start("ts", minutes, off).alias("__bar"))
        .agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
             F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.max("ts").alias("close_ts"), *extra)
        .withColumnRenamed("__bar", "ts")
    )


def resample_by_count(bars: DataFrame, k: int, keys: Sequence[str] = SYM) -> DataFrame:
    """Group every k bars of a series; an incomplete last group is dropped."""
    d = with_ordinal(bars, keys, ["ts"], day_of("ts"))
    return (
        d.groupBy(*keys, F.floor((F.col("ord") - 1) / k).alias("grp"))
        .agg(F.min("ts").alias("ts"), F.min_by("open", "ord").alias("open"), F.max("high").alias("high"),
             F.min("low").alias("low"), F.max_by("close", "ord").alias("close"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") == k).drop("n")
    )


def rth(ts="ts", start: int = RTH_OPEN, end: int = RTH_CLOSE) -> Column:
    """Regular hours, inclusive at both ends (loaders use an end of 1020)."""
    return minute_of_day(ts).between(start, end)


def trading_calendar(bars: DataFrame, end: int = 1020) -> DataFrame:
    return bars.where(rth("ts", RTH_OPEN, end)).select(F.to_date("ts").alias("date")).distinct()


def daily_bars(bars: DataFrame, keys: Sequence[str] = SYM, regular_hours: bool = True) -> DataFrame:
    d = bars.where(rth()) if regular_hours else bars
    return d.groupBy(*keys, F.to_date("ts").alias("date")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.max("ts").alias("last_ts"))


def session_tag(ts="ts") -> Column:
    """Trading session of a bar: Asia from 20:00, London 02:00-05:00, New York 09:30-16:00."""
    m = minute_of_day(ts)
    return (
        F.when(m >= 1200, "ASIA").when((m >= 120) & (m < 300), "LONDON")
        .when((m >= RTH_OPEN) & (m < RTH_CLOSE), "NY").otherwise("OFF")
    )


def eod_bars(bars: DataFrame, exit_minute: int, keys: Sequence[str] = SYM) -> DataFrame:
    """The bar that closes each date: first regular bar at or after the exit minute, else the last one."""
    return (
        bars.where(rth()).groupBy(*keys, F.to_date("ts").alias("date"))
        .agg(F.coalesce(F.min(F.when(minute_of_day() >= exit_minute, F.col("ts"))), F.max("ts")).alias("eod_ts"))
    )


def session_levels(bars: DataFrame, valid_days: int = 2, keys: Sequence[str] = SYM) -> DataFrame:
    """High/low of each session, listed for the day they form (0) and the ``valid_days`` after it.

    Asia belongs to the calendar day it leads into. The previous-day pair is taken over all bars of the
    calendar day before.
    """
    m = minute_of_day()
    kinds = F.array_compact(F.array(
        F.lit("day"), *[F.when((m >= a) & (m < b), F.lit(k)) for k, (a, b) in SESSIONS.items()]))
    d = bars.select(*keys, "high", "low", F.to_date("ts").alias("__d"), F.explode(kinds).alias("kind"))
    form = F.when(F.col("kind").isin("asia", "day"), F.date_add("__d", 1)).otherwise(F.col("__d"))
    lv = d.groupBy(*keys, form.alias("formed"), "kind").agg(F.max("high").alias("high"), F.min("low").alias("low"))
    age = F.explode(F.sequence(F.lit(0), F.when(F.col("kind") == "day", 0).otherwise(valid_days)))
    return lv.withColumn("age", age).withColumn("date", F.date_add("formed", F.col("age"))).select(
        *keys, "date", F.when(F.col("kind") == "day", "prev_day").otherwise(F.col("kind")).alias("kind"), "age", "high", "low")


def anchor_opens(bars: DataFrame, keys: Sequence[str] = SYM) -> DataFrame:
    """Midnight open and week open attached to every date."""
    daily = bars.groupBy(*keys, F.to_date("ts").alias("date")).agg(F.min_by("open", "ts").alias("midnight_open"))
    week = Window.partitionBy(*keys, F.date_trunc("week", "date")).orderBy("date")
    return daily.withColumn("week_open", F.first("midnight_open").over(week))


def running_day_extremes(bars: DataFrame, keys: Sequence[str] = SYM) -> DataFrame:
    w = Window.partitionBy(*keys, F.to_date("ts")).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return bars.withColumns({"day_high": F.max("high").over(w), "day_low": F.min("low").over(w)})


def pre_session_range(bars: DataFrame, start: int, end: int, keys: Sequence[str] = SYM) -> DataFrame:
    """Range of a window before the session; a window that wraps midnight belongs to the next date."""
    m = minute_of_day()
    if start <= end:
        inside, date = (m >= start) & (m < end), F.to_date("ts")
    else:
        inside, date = (m >= start) | (m < end), F.when(m >= start, F.date_add(F.to_date("ts"), 1)).otherwise(F.to_date("ts"))
    return bars.where(inside).groupBy(*keys, date.alias("date")).agg(
        F.max("high").alias("pre_high"), F.min("low").alias("pre_low"),
        F.min_by("open", "ts").alias("pre_open"), F.max_by("close", "ts").alias("pre_close"), F.count(F.lit(1)).alias("bars"))


def fair_price(bars: DataFrame, keys: Sequence[str] = SYM) -> DataFrame:
    """Opening price of the bar's session, carried through the session."""
    d = bars.withColumns({"session": session_tag(), "date": F.to_date("ts")})
    w = Window.partitionBy(*keys, "date", "session").orderBy("ts")
    return d.withColumn("fair", F.when(F.col("session") != "OFF", F.first("open").over(w)))
