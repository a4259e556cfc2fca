"""Queries over sources and sinks: written to the shared folder and read back."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barloom.functions.trade import with_trade_pnl
from barloom.plans.bindings import bars, daily, r_trades, table, trades
from barloom.plans.registry import query
from barloom.session import shared_folder
from barloom.sources import bars as SB
from barloom.sources import datasets as SD
from barloom.sources import trades as ST


def fresh(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("bars_roundtrip", "symbol ts close:r", "SELECT * FROM bars WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-10'")
def _(spark, sf):
    path = fresh(spark, "bars")
    SB.write_bars(bars(spark, sf), path)
    return SB.read_bars(spark, path, "2024-01-05", "2024-01-10")


@query("bar_text", "symbol ts open:r close:r volume:r", "SELECT symbol, date_trunc('second', ts) AS ts, open, close, volume FROM bars")
def _(spark, sf):
    path = fresh(spark, "text")
    b = bars(spark, sf)
    t = b.select(F.date_format("ts", "yyyy/MM/dd").alias("Date"), F.date_format("ts", "HH:mm:ss").alias(" Time"), F.col("open").alias(" Open"), F.col("high").alias(" High"), F.col("low").alias(" Low"), F.col("close").alias(" Last"), F.col("volume").alias(" Volume"), "symbol")
    t.write.partitionBy("symbol").option("header", "true").csv(path)
    return SB.read_bar_text(spark, path)


@query("read_daily", "symbol date:d close:r", "SELECT * FROM daily")
def _(spark, sf):
    path = fresh(spark, "daily")
    daily(spark, sf).select("symbol", F.col("date").alias("Date"), F.col("open").alias("Open"), F.col("close").alias("Last")).write.parquet(path)
    return SB.read_daily(spark, path)


@query("trade_log", "entry_time:s direction:s entry_price:s initial_sl:s exit_reason:s slippage_paid:s", """SELECT strftime(entry_ts, '%Y-%m-%d %H:%M:%S.%f') AS entry_time, CASE WHEN direction = 1 THEN 'long' ELSE 'short' END AS direction, printf('%.2f', entry_price) AS entry_price,
    printf('%.2f', initial_sl_price) AS initial_sl, exit_reason, printf('%.2f', slippage_paid) AS slippage_paid FROM pnl""")
def _(spark, sf):
    path = fresh(spark, "log")
    t = with_trade_pnl(trades(spark, sf).withColumns({"entry_bar": F.col("trade_id"), "exit_bar": F.col("trade_id") + 1, "trade_reason": F.lit(None).cast("string"), "had_trailing": F.lit(False)}))
    ST.write_trade_log(t.withColumns({"entry_ts": F.date_format("entry_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")}), "demo", path)
    return spark.read.option("header", "true").csv(path)


@query("ml_dataset_roundtrip", "split:s n:i missing:i", "SELECT CASE WHEN date < DATE '1999-01-01' THEN 'train' ELSE 'test' END AS split, count(*) AS n, 0 AS missing FROM r_trades GROUP BY 1")
def _(spark, sf):
    path = fresh(spark, "ml")
    d = r_trades(spark, sf).withColumn("split", F.when(F.col("date") < F.lit("1999-01-01").cast("date"), "train").otherwise("test"))
    SD.write_ml_dataset(d.select("trade_id", "r", "split"), path)
    return SD.read_ml_dataset(spark, path, ["trade_id", "split", "added"], ["added"]).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("added").alias("missing"))


@query("json_map", "key:s n:i total:r", "SELECT 'k' AS key, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS total FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def _(spark, sf):
    d = SD.explode_json_map(table(spark, sf, "events").select("event_id", "props"), "props", "double")
    return SD.split_key(d).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("sweep_results_roundtrip", "combo_id:s n_trades:i avg_r:r", "SELECT config_idx::VARCHAR AS combo_id, count(*) AS n_trades, avg(r) AS avg_r FROM r_trades GROUP BY 1")
def _(spark, sf):
    path = fresh(spark, "sweep")
    g = r_trades(spark, sf).groupBy(F.col("config_idx").cast("string").alias("combo_id")).agg(F.count(F.lit(1)).alias("n_trades"), F.avg("r").alias("avg_r"))
    even = F.col("combo_id").cast("int") % 2 == 0
    SD.append_sweep_results(g.where(even), path)
    SD.append_sweep_results(g.where(~even), path)
    return SD.read_sweep_results(spark, path, "combo_id string, n_trades int, avg_r double")
