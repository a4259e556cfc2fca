"""As-of, interval and neighbourhood joins as equi joins on bounded buckets."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.scan import prefix


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str | Column,
    payload: Sequence[str],
    strict: bool = False,
    unit: str = "day",
    block: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Last right row at or before (``strict``: before) each left row; NULL payload if none.

    Both sides are merged once by (key, time block) and the last value is carried across blocks, so a
    hot key is spread over its blocks (``unit`` of time, or ``block`` of the ordering value).
    """
    r_ts = F.col(right_ts) if isinstance(right_ts, str) else right_ts
    lt = left.schema[left_ts].dataType
    l = left.select(*keys, F.col(left_ts).alias("__t"), F.lit(0 if strict else 1).alias("__side"),
                    F.struct(*[c for c in left.columns]).alias("__l"))
    r = right.select(*keys, r_ts.cast(lt).alias("__t"), F.lit(1 if strict else 0).alias("__side"),
                     F.struct(*payload).alias("__r"))
    both = l.unionByName(r, allowMissingColumns=True)
    both = prefix(both, keys, ["__t", "__side"], {"__m": ("last", F.col("__r"))}, F.date_trunc(unit, F.col("__t")) if block is None else block(F.col("__t")))
    return both.where(F.col("__l").isNotNull()).select("__l.*", *[F.col(f"__m.{p}").alias(p) for p in payload])


def prior_day_join(bars: DataFrame, daily: DataFrame, keys: Sequence[str], ts: str, date: str, payload: Sequence[str]) -> DataFrame:
    """Attach the last daily row with date strictly before the bar's date.

    Resolved once per (key, calendar day) on the two small day tables, then one equi join to the bars.
    """
    days = bars.select(*keys, F.to_date(ts).alias("__d")).distinct().withColumn("__want", F.lit(True))
    d = daily.select(*keys, F.to_date(date).alias("__d"), F.struct(*payload).alias("__r"))
    w = Window.partitionBy(*keys).orderBy("__d").rowsBetween(Window.unboundedPreceding, -1)
    both = days.join(d, [*keys, "__d"], "full").withColumn("__m", F.last("__r", ignorenulls=True).over(w))
    lookup = both.where("__want").select(*keys, "__d", *[F.col(f"__m.{p}").alias(p) for p in payload])
    return bars.withColumn("__d", F.to_date(ts)).join(lookup, [*keys, "__d"], "left").drop("__d")


def interval_join(
    spans: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    at: str,
    unit: str = "day",
    residual: Column | None = None,
    salts: int = 1,
) -> DataFrame:
    """Pair each [start, end] span with the points inside it.

    Each span is listed under the time buckets it touches and equi-joined with the points of the same
    bucket. ``salts`` > 1 spreads the spans of a crowded bucket over several tasks; the points of a bucket
    are copied that many times (one bar per minute bounds them).
    """
    step = {"day": "INTERVAL 1 DAY", "hour": "INTERVAL 1 HOUR", "week": "INTERVAL 7 DAY"}[unit]
    first, last = F.date_trunc(unit, F.col(start)), F.date_trunc(unit, F.col(end))
    hit = (F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))
    if residual is not None:
        hit = hit & residual
    s = spans.withColumn("__bk", F.explode(F.sequence(first, last, F.expr(step))))
    p = points.withColumn("__bk", F.date_trunc(unit, F.col(at)))
    on = [*keys, "__bk"]
    if salts > 1:
        s = s.withColumn("__salt", F.pmod(F.xxhash64(*spans.columns[:3]), F.lit(salts)).cast("int"))
        p = p.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
        on.append("__salt")
    return s.join(p, on).where(hit).drop("__bk", "__salt")


def spread_join(left: DataFrame, right: DataFrame, on: Sequence[str], rows: int, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` (one row a key), where keys that hold a partition's share of the left rows are split.

    ``rows``: of the left side. Fewer keys than there are partitions can hold such a share: that many rows are broadcast. The
    left rows of such a key are dealt to as many salts as it has shares, and its right row is copied for each.
    """
    share = max(1, rows // int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    crowded = left.groupBy(*on).count().where(F.col("count") > share)
    crowded = F.broadcast(crowded.select(*on, F.ceil(F.col("count") / share).cast("int").alias("__salts")))
    columns = left.columns
    l = left.join(crowded, list(on), "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(*columns), F.col("__salts")).cast("int"), F.lit(0)))
    r = right.join(crowded, list(on), "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts") - 1, F.lit(0)))))
    return l.drop("__salts").join(r.drop("__salts"), [*on, "__salt"], how).drop("__salt")


def ordinal_join(spans: DataFrame, points: DataFrame, keys: Sequence[str], lo: str, hi: str, at: str, size: int = 256) -> DataFrame:
    """``interval_join`` over row positions: pairs lo <= at <= hi through blocks of ``size`` positions."""
    s = spans.withColumn("__bk", F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size))))
    p = points.withColumn("__bk", F.floor(F.col(at) / size))
    return s.join(p, [*keys, "__bk"]).where((F.col(at) >= F.col(lo)) & (F.col(at) <= F.col(hi))).drop("__bk")


def range_extremes(spans: DataFrame, bars: DataFrame, keys: Sequence[str], ident: str, start: str, end: str, at: str) -> DataFrame:
    """Highest high and lowest low of each span.

    Whole days inside a span read one row of a day table; bars are read for the first and last day only,
    so a long span costs days, not bars.
    """
    s = spans.select(*keys, ident, F.col(start).alias("__s"), F.col(end).alias("__e"),
                     F.to_date(start).alias("__ds"), F.to_date(end).alias("__de"))
    b = bars.select(*keys, F.col(at).alias("__at"), F.to_date(at).alias("__d"), "high", "low")
    days = b.groupBy(*keys, "__d").agg(F.max("high").alias("high"), F.min("low").alias("low"))
    edge = (
        s.withColumn("__d", F.explode(F.array_distinct(F.array("__ds", "__de")))).join(b, [*keys, "__d"])
        .where((F.col("__at") >= F.col("__s")) & (F.col("__at") <= F.col("__e"))).select(ident, "high", "low")
    )
    inner = (
        s.where(F.datediff("__de", "__ds") >= 2)
        .withColumn("__d", F.explode(F.sequence(F.date_add("__ds", 1), F.date_sub("__de", 1))))
        .join(days, [*keys, "__d"]).select(ident, "high", "low")
    )
    return edge.unionByName(inner).groupBy(ident).agg(F.max("high").alias("span_high"), F.min("low").alias("span_low"))


def grid(spark_df: DataFrame, **axes) -> DataFrame:
    """Cartesian product of literal parameter lists, appended to each input row (fixed fan-out)."""
    d = spark_df
    for name, values in axes.items():
        d = d.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return d


def missing_combos(wanted: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """Combinations not yet computed."""
    return wanted.join(done.select(*on).distinct(), list(on), "left_anti")


def only_configs(df: DataFrame, configs: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of the requested configurations."""
    return df.join(configs.select(*on).distinct(), list(on), "left_semi")


def default_lookup(rows: DataFrame, daily: DataFrame, on: Sequence[str], defaults: dict) -> DataFrame:
    """Left-join a one-row-per-day table and fill rows without a match."""
    d = rows.join(daily.select(*on, *defaults), list(on), "left")
    return d.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


NODE, TALL = 16, 6  # time nodes hold so many nodes of the tier below; tiers of nodes over hours (16 ** 6 hours: 1,900 years)


def life_nodes(start: Column, end: Column) -> Column:
    """The fewest time nodes, as (tier, node), that cover the hours from ``start`` to ``end`` (NULL: for ever)."""
    hour = lambda t: F.floor(F.unix_micros(t.cast("timestamp")) / 3_600_000_000)
    lo, hi = hour(start), F.coalesce(hour(end) + 1, F.lit(NODE ** TALL).cast("long"))
    edges = [(F.ceil(lo / NODE**k), F.floor(hi / NODE**k)) for k in range(TALL)]
    span = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
    parts = []
    for k, (a, b) in enumerate(edges):
        own = span(a, b)
        if k + 1 < TALL:
            # What whole nodes of the tier above cover is theirs.
            up_a, up_b = edges[k + 1]
            own = F.when(up_a < up_b, F.concat(span(a, up_a * NODE), span(up_b * NODE, b))).otherwise(own)
        parts.append(_tiered(own, k))
    return F.concat(*parts)


def _tiered(nodes: Column, k: int) -> Column:
    return F.transform(nodes, lambda n: F.struct(F.lit(k).alias("tier"), n.alias("node")))


def nodes_at(t: Column) -> Column:
    """The time node of each tier that holds ``t``."""
    hour = F.floor(F.unix_micros(t.cast("timestamp")) / 3_600_000_000)
    return F.array(*[F.struct(F.lit(k).alias("tier"), F.floor(hour / NODE**k).alias("node")) for k in range(TALL)])


def live_levels(prices: DataFrame, levels: DataFrame, keys: Sequence[str], price: str, level: str, tol: float, at: str, start: str, end: str | None) -> DataFrame:
    """Pairs of prices with the levels within ``tol`` that live at that time (after ``start``, not after ``end``), up to an hour at either end.

    A level is listed under the time nodes that cover its life, for its own price bucket of width ``tol`` and both
    neighbours; a price under one node a tier. So a pair meets once, and only while the level lives.
    """
    bucket = lambda c: F.floor(F.col(c) / tol).cast("long")
    life = life_nodes(F.col(start), F.lit(None).cast("timestamp") if end is None else F.col(end))
    l = levels.withColumn("__n", F.explode(life)).withColumn("__b", F.explode(F.array(bucket(level) - 1, bucket(level), bucket(level) + 1)))
    p = prices.withColumn("__n", F.explode(nodes_at(F.col(at)))).withColumn("__b", bucket(price))
    return p.join(l, [*keys, "__b", "__n"]).drop("__b", "__n")


def level_match(prices: DataFrame, levels: DataFrame, keys: Sequence[str], price: str, level: str, tol: float, at: str, start: str, pick: Column, payload: Sequence[str], ident: Sequence[str], end: str | None = None, on_end: bool = True) -> DataFrame:
    """First level (by ``pick``) within ``tol`` of each price that began before it and has not ended, by an index over price and life.

    ``end`` NULL, or no such column: the level lives on; ``on_end``: it still counts at its end. The aggregation keeps one match per price and combines before it
    shuffles.
    """
    alive = F.col(start) < F.col(at)
    if end is not None:
        alive = alive & (F.col(end).isNull() | (F.col(at) <= F.col(end) if on_end else F.col(at) < F.col(end)))
    hit = live_levels(prices, levels, keys, price, level, tol, at, start, end).where((F.abs(F.col(level) - F.col(price)) <= tol) & alive)
    best = hit.groupBy(*ident).agg(F.min_by(F.struct(*payload), pick).alias("__m"))
    return prices.join(best, list(ident), "left").select(*prices.columns, *[F.col(f"__m.{c}").alias(c) for c in payload])
