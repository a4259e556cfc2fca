"""Adapters from the test tables to bar, day and trade tables, with the same definitions in SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.bars import resample_ticks
from barloom.operators.scan import framed, hour_of
from barloom.plans.registry import cte
from barloom.session import cut


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_type").alias("symbol"), "ts", "event_id", "user_id", F.col("value").alias("price"))


def bars(spark: SparkSession, sf: str, minutes: int = 30) -> DataFrame:
    return resample_ticks(ticks(spark, sf), minutes, offset=0)


def stored_bars(spark: SparkSession, sf: str, minutes: int = 30) -> DataFrame:
    """The bars written once, as a bar table would be, for queries that read them in several places."""
    return cut(bars(spark, sf, minutes))


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """Multi-year day bars of order totals, one series per priority class."""
    o = table(spark, sf, "orders").select(
        F.when(F.substring("o_orderpriority", 1, 1).isin("1", "2"), "HI").otherwise("LO").alias("symbol"),
        F.to_date("o_orderdate").alias("date"), "o_orderkey", F.col("o_totalprice").alias("p"))
    return o.groupBy("symbol", "date").agg(
        F.min_by("p", "o_orderkey").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"),
        F.max_by("p", "o_orderkey").alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))


def trades(spark: SparkSession, sf: str) -> DataFrame:
    """One trade per event, closed at the same user's next event."""
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")

    def close_at_next(d, w):
        return d.withColumns({"exit_ts": F.lead("ts").over(w), "exit_price": F.lead("value").over(w)})

    d = framed(e, ["user_id"], ["ts", "event_id"], close_at_next, after=1, block=hour_of("ts")).where(F.col("exit_ts").isNotNull())
    way = F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1)
    risk = 5.0 + F.col("user_id") % 5
    return d.select(
        F.col("event_id").alias("trade_id"), F.col("user_id").alias("run_id"), F.col("event_type").alias("symbol"),
        F.col("ts").alias("entry_ts"), "exit_ts", F.col("value").alias("entry_price"), "exit_price", way.alias("direction"),
        (1 + F.col("event_id") % 3).cast("double").alias("contracts"), F.lit(0.25).alias("slippage_points"),
        F.lit(2.0).alias("commission_per_contract"),
        F.element_at(F.array(*[F.lit(x) for x in ("SL", "TP", "EOD", "SIGNAL", "SAME_BAR_SL")]), (F.col("event_id") % 5 + 1).cast("int")).alias("exit_reason"),
        F.when(F.col("event_id") % 7 != 0, F.col("value") - way * risk).alias("sl_price"), (F.col("value") + way * 2 * risk).alias("tp_price"),
        (F.col("value") - way * risk).alias("initial_sl_price"), (F.col("value") + way * 2 * risk).alias("initial_tp_price"),
        (-(F.col("event_id") % 11)).cast("double").alias("mae_points"), (F.col("event_id") % 13).cast("double").alias("mfe_points"))


def r_trades(spark: SparkSession, sf: str) -> DataFrame:
    """Multi-year R multiples per configuration, with a deterministic score."""
    o = table(spark, sf, "orders")
    return o.select(
        (F.col("o_custkey") % 20).alias("config_idx"), F.col("o_orderkey").alias("trade_id"), F.to_date("o_orderdate").alias("date"),
        ((F.col("o_totalprice") - 250000.0) / 100000.0).alias("r"), ((F.col("o_orderkey") * 37) % 101 / 100.0 - 0.5).alias("pred"),
        F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") * 13 % 390).cast("int").alias("minute"))


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Per-path account outcomes: one path per order over accounts, schemes and two risk axes."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.when(F.col("o_custkey") % 2 == 0, "25K").otherwise("50K").alias("account"),
        F.when(k % 3 == 0, "frac_dd").otherwise("fixed_dollar").alias("scheme"),
        ((k % 4 + 1) / 10.0).alias("erp"), ((F.floor(k / 4) % 4 + 1) / 10.0).alias("frp"), k.alias("path"),
        (F.col("o_orderstatus") == "F").alias("passed"), (F.col("o_custkey") % 30 + 1).cast("int").alias("eval_days"),
        F.greatest(F.lit(0.0), F.col("o_totalprice") - 200000.0).alias("withdrawn"), (k % 5).cast("int").alias("n_payouts"),
        (F.col("o_custkey") % 60 + 10).cast("double").alias("funded_days")).withColumns({
        "payout_days": F.when(F.col("n_payouts") > 0, F.transform(F.sequence(F.lit(1), F.col("n_payouts")), lambda i: (i * 8 + F.col("path") % 6).cast("double"))).otherwise(F.array().cast("array<double>")),
        "payout_amounts": F.when(F.col("n_payouts") > 0, F.transform(F.sequence(F.lit(1), F.col("n_payouts")), lambda i: (i * 50 + F.col("path") % 900 + 500).cast("double"))).otherwise(F.array().cast("array<double>")),
    })


cte("ticks", "SELECT event_type AS symbol, ts, event_id, user_id, value AS price FROM events")
cte("bars", """SELECT symbol, time_bucket(INTERVAL 30 MINUTE, ts) AS ts, arg_min(price, ts) AS open, max(price) AS high,
    min(price) AS low, arg_max(price, ts) AS close, CAST(count(*) AS DOUBLE) AS volume FROM ticks GROUP BY 1, 2""")
cte("nbars", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM bars")
cte("daily", """SELECT CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'HI' ELSE 'LO' END AS symbol, CAST(o_orderdate AS DATE) AS date,
    arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
    arg_max(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume FROM orders GROUP BY 1, 2""")
cte("trades", """SELECT event_id AS trade_id, user_id AS run_id, event_type AS symbol, ts AS entry_ts, exit_ts, value AS entry_price, exit_price, way AS direction,
    CAST(1 + event_id % 3 AS DOUBLE) AS contracts, 0.25::DOUBLE AS slippage_points, 2.0::DOUBLE AS commission_per_contract,
    CASE event_id % 5 WHEN 0 THEN 'SL' WHEN 1 THEN 'TP' WHEN 2 THEN 'EOD' WHEN 3 THEN 'SIGNAL' ELSE 'SAME_BAR_SL' END AS exit_reason,
    CASE WHEN event_id % 7 <> 0 THEN value - way * risk END AS sl_price, value + way * 2 * risk AS tp_price,
    value - way * risk AS initial_sl_price, value + way * 2 * risk AS initial_tp_price,
    -CAST(event_id % 11 AS DOUBLE) AS mae_points, CAST(event_id % 13 AS DOUBLE) AS mfe_points
    FROM (SELECT *, lead(ts) OVER u AS exit_ts, lead(value) OVER u AS exit_price, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS way,
          5.0::DOUBLE + user_id % 5 AS risk FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE exit_ts IS NOT NULL""")
cte("pnl", """SELECT *, (exit_price - entry_price) * direction AS pnl_points, (exit_price - entry_price) * direction * contracts * 20 AS pnl_dollars,
    2 * slippage_points * contracts * 20 AS slippage_paid, 2 * commission_per_contract * contracts AS commission_paid,
    (exit_price - entry_price) * direction / abs(entry_price - initial_sl_price) AS r_multiple,
    mae_points / abs(entry_price - initial_sl_price) AS mae_r, mfe_points / abs(entry_price - initial_sl_price) AS mfe_r,
    (exit_price - entry_price) * direction * contracts * 20 - 2 * slippage_points * contracts * 20 - 2 * commission_per_contract * contracts AS net
    FROM trades""")
cte("r_trades", """SELECT o_custkey % 20 AS config_idx, o_orderkey AS trade_id, CAST(o_orderdate AS DATE) AS date,
    (o_totalprice - 250000.0::DOUBLE) / 100000.0::DOUBLE AS r, (o_orderkey * 37) % 101 / 100.0::DOUBLE - 0.5::DOUBLE AS pred,
    o_orderstatus AS status, o_orderkey * 13 % 390 AS minute FROM orders""")
cte("outcomes", """SELECT CASE WHEN o_custkey % 2 = 0 THEN '25K' ELSE '50K' END AS account,
    CASE WHEN o_orderkey % 3 = 0 THEN 'frac_dd' ELSE 'fixed_dollar' END AS scheme, (o_orderkey % 4 + 1) / 10.0::DOUBLE AS erp,
    ((o_orderkey // 4) % 4 + 1) / 10.0::DOUBLE AS frp, o_orderkey AS path, o_orderstatus = 'F' AS passed, o_custkey % 30 + 1 AS eval_days,
    greatest(0.0::DOUBLE, o_totalprice - 200000.0) AS withdrawn, o_orderkey % 5 AS n_payouts, CAST(o_custkey % 60 + 10 AS DOUBLE) AS funded_days FROM orders""")
