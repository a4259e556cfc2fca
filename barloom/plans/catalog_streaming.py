"""Streaming operators run to completion over the event file; each is checked against its batch twin."""
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from barloom.operators import bars as B
from barloom.operators.clean import keep_last
from barloom.plans.bindings import bars, table
from barloom.plans.catalog_io import fresh
from barloom.plans.registry import cte, query
from barloom.streaming import live as L


def live_ticks(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return as_ticks(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf))


def as_ticks(events):
    return events.select(F.col("event_type").alias("symbol"), "ts", "event_id", "user_id", F.col("value").alias("price"))


def live_minute_bars(spark, sf):
    return minute_bars(live_ticks(spark, sf))


def minute_bars(ticks):
    """Every tick as a one-print bar on its minute."""
    p = F.col("price")
    return ticks.select("symbol", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("ts"), p.alias("open"), p.alias("high"), p.alias("low"), p.alias("close"), F.lit(1.0).alias("volume"))


def drain(stream, spark, name: str):
    """Append a stream to the shared folder until its input is used up, and read the result."""
    path = fresh(spark, name)
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


ARRIVAL = 400_000  # events of a micro-batch


def drain_arrivals(build, spark, sf: str, name: str, rows: int = ARRIVAL):
    """``drain`` of ``build(ticks)`` over the event table as a feed delivers it: some ``rows`` events after the other, in time order.

    A file is one micro-batch however large it is, so queries that sort a batch or let it wait in their state would hold the
    whole table. Here every range of time arrives and runs by itself, on the state of the one before.
    """
    events = table(spark, sf, "events")
    path, staged = fresh(spark, name), fresh(spark, name + "-staged")
    ranges = max(1, -(-events.count() // rows))
    events.repartitionByRange(ranges, "ts").withColumn("part", F.spark_partition_id()).write.partitionBy("part").parquet(staged)
    stage = spark.read.schema(StructType([*events.schema, StructField("part", IntegerType())])).parquet(staged)
    parts = sorted(r.part for r in stage.select("part").distinct().collect()) or [0]  # a number a range
    for part in parts:
        stage.where(F.col("part") == part).drop("part").write.mode("append").parquet(path + "-in")
        stream = build(as_ticks(spark.readStream.schema(events.schema).parquet(path + "-in")))
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def drain_updates(stream, spark, name: str, keys: list[str]):
    """Run an updating stream; every micro-batch is stored under its number and the newest row per key kept."""
    path = fresh(spark, name)

    def store(batch, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/part={number}")

    stream.writeStream.foreachBatch(store).option("checkpointLocation", path + "-state").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    return keep_last(spark.read.parquet(path).drop("part"), keys, ["batch"]).drop("batch")


cte("mb", "SELECT symbol, date_trunc('minute', ts) AS ts, price FROM ticks")


@query("stream_resample", "symbol ts open:r high:r low:r close:r volume:r", "SELECT * FROM bars WHERE ts + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def _(spark, sf):
    return drain(L.stream_resample(live_ticks(spark, sf), 30), spark, "resample")


@query("stream_dedup", "symbol ts", "SELECT DISTINCT symbol, ts FROM mb")
def _(spark, sf):
    return drain(L.stream_dedup(live_minute_bars(spark, sf)).select("symbol", "ts"), spark, "dedup")


@query("stream_session_levels", "symbol date:d session:s high:r low:r", """SELECT symbol, CAST(ts AS DATE) AS date, CASE WHEN m >= 1200 THEN 'ASIA' WHEN m >= 120 AND m < 300 THEN 'LONDON' WHEN m >= 570 AND m < 960 THEN 'NY' ELSE 'OFF' END AS session, max(price) AS high, min(price) AS low
    FROM (SELECT *, hour(ts) * 60 + minute(ts) AS m FROM mb) GROUP BY 1, 2, 3""")
def _(spark, sf):
    return drain_updates(L.stream_session_levels(live_minute_bars(spark, sf)), spark, "levels", ["symbol", "date", "session"])


@query("stream_sliding_vwap", "symbol start end_ts vwap:r", """SELECT symbol, s AS start, s + INTERVAL 60 MINUTE AS end_ts, avg((price + price + price) / 3) AS vwap FROM (SELECT symbol, price, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM mb)
    WHERE s + INTERVAL 60 MINUTE <= (SELECT max(ts) FROM mb) - INTERVAL 10 MINUTE GROUP BY 1, 2""")
def _(spark, sf):
    return drain(L.stream_sliding_vwap(live_minute_bars(spark, sf), "60 minutes", "30 minutes"), spark, "vwap").withColumnRenamed("end", "end_ts")


@query("stream_trade_sessions", "symbol start n:i total:r", """WITH g AS (SELECT *, sum(nw) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS k FROM (SELECT *, (lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 20 MINUTE)::INT AS nw FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, event_id)))
    SELECT symbol, min(ts) AS start, count(*) AS n, sum(price) AS total FROM g GROUP BY symbol, k HAVING max(ts) + INTERVAL 20 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def _(spark, sf):
    return drain(L.stream_trade_sessions(live_ticks(spark, sf), "20 minutes"), spark, "sessions")


@query("stream_asof_enrich", "symbol ts price:r d_close:r", "SELECT m.symbol, m.ts, m.price, d.prev_close AS d_close FROM mb m LEFT JOIN (SELECT symbol, date + 1 AS date, close AS prev_close FROM (SELECT symbol, CAST(ts AS DATE) AS date, arg_max(close, ts) AS close FROM bars GROUP BY 1, 2)) d ON d.symbol = m.symbol AND d.date = CAST(m.ts AS DATE)")
def _(spark, sf):
    lv = B.daily_bars(bars(spark, sf), regular_hours=False).select("symbol", F.date_add("date", 1).alias("date"), F.col("close").alias("d_close"))
    return drain(L.stream_asof_enrich(live_minute_bars(spark, sf), lv).select("symbol", "ts", F.col("close").alias("price"), "d_close"), spark, "enrich")


@query("stream_gap_monitor", "symbol prev_ts ts gap:s", """SELECT symbol, prev_ts, ts, CASE WHEN floor((epoch(ts) - epoch(prev_ts)) / 60) <= 5 THEN 'minor' WHEN floor((epoch(ts) - epoch(prev_ts)) / 60) <= 360 THEN 'session' ELSE 'large' END AS gap FROM (
    SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS prev_ts FROM (SELECT DISTINCT symbol, ts FROM mb)) WHERE epoch(ts) - epoch(prev_ts) > 60 AND NOT hour(prev_ts) * 60 + minute(prev_ts) BETWEEN 955 AND 1085 AND isodow(prev_ts) <> 5""")
def _(spark, sf):
    return drain_arrivals(lambda t: L.stream_gap_monitor(minute_bars(t).select("symbol", "ts"), 1), spark, sf, "gaps")


@query("stream_fvg", "symbol ts direction:i near:r far:r", """SELECT symbol, ts, CASE WHEN h2 < price THEN 1 ELSE -1 END AS direction, h2 AS near, price AS far FROM (SELECT symbol, ts, price, lag(price, 2) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS h2 FROM ticks) WHERE h2 <> price""")
def _(spark, sf):
    return drain_arrivals(lambda t: L.stream_fvg(t.select("symbol", "ts", F.col("price").alias("high"), F.col("price").alias("low"))), spark, sf, "fvg")


cte("passed", "SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE AS ts FROM events")


@query("stream_gap_monitor_late", "symbol prev_ts ts gap:s", """SELECT symbol, prev_ts, ts, CASE WHEN floor((epoch(ts) - epoch(prev_ts)) / 60) <= 5 THEN 'minor' WHEN floor((epoch(ts) - epoch(prev_ts)) / 60) <= 360 THEN 'session' ELSE 'large' END AS gap FROM (
    SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS prev_ts FROM (SELECT DISTINCT symbol, ts FROM mb WHERE ts <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM mb)))
    WHERE epoch(ts) - epoch(prev_ts) > 60 AND NOT hour(prev_ts) * 60 + minute(prev_ts) BETWEEN 955 AND 1085 AND isodow(prev_ts) <> 5""")
def _(spark, sf):
    return drain_arrivals(lambda t: L.stream_gap_monitor_late(minute_bars(t).select("symbol", "ts"), 1), spark, sf, "gaps-late")


@query("stream_fvg_ends", "symbol since ts direction:i near:r far:r", """WITH k AS (SELECT symbol, ts, price, row_number() OVER w AS n, lag(price, 2) OVER w AS h2 FROM ticks WHERE ts <= (SELECT ts FROM passed) WINDOW w AS (PARTITION BY symbol ORDER BY ts, event_id)),
    z AS (SELECT symbol, n, ts, CASE WHEN h2 < price THEN 1 ELSE -1 END AS direction, h2 AS near, price AS far FROM k WHERE h2 <> price)
    SELECT z.symbol, z.ts AS since, arg_min(k.ts, k.n) AS ts, direction, near, far FROM z JOIN k ON k.symbol = z.symbol AND k.n > z.n AND (k.price - near) * direction <= 0 GROUP BY z.symbol, z.n, z.ts, direction, near, far""")
def _(spark, sf):
    return drain_arrivals(lambda t: L.stream_fvg_ends(t.select("symbol", "ts", "event_id", F.col("price").alias("high"), F.col("price").alias("low"))), spark, sf, "fvg-ends")
