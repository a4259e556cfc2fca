"""Queries over trades, orders and exits."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions import scalar as S
from barloom.functions import trade as T
from barloom.operators import bars as B
from barloom.operators import exits as X
from barloom.operators import indicators as I
from barloom.operators import perf as P
from barloom.operators.joins import asof_join, interval_join
from barloom.operators.scan import framed, hour_of, with_ordinal
from barloom.plans.bindings import bars, table, trades
from barloom.plans.registry import cte, query


def pnl(spark, sf):
    return T.with_trade_pnl(trades(spark, sf))


@query("trade_pnl", "trade_id:i pnl_points:r pnl_dollars:r slippage_paid:r commission_paid:r net_pnl_dollars:r is_winner:b r_multiple:r mae_r:r mfe_r:r",
       "SELECT *, net AS net_pnl_dollars, net > 0 AS is_winner FROM pnl")
def _(spark, sf):
    return pnl(spark, sf)


@query("reverse_trades", "trade_id:i direction:i sl_price:r tp_price:r initial_sl_price:r mae_points:r exit_reason:s net_pnl_dollars:r",
       """SELECT trade_id, -direction AS direction, tp_price AS sl_price, sl_price AS tp_price, initial_tp_price AS initial_sl_price, mfe_points AS mae_points,
       CASE exit_reason WHEN 'SL' THEN 'TP' WHEN 'TP' THEN 'SL' WHEN 'SAME_BAR_SL' THEN 'SAME_BAR_TP' ELSE exit_reason END AS exit_reason,
       -pnl_dollars - slippage_paid - commission_paid AS net_pnl_dollars FROM pnl""")
def _(spark, sf):
    return T.with_trade_pnl(T.reverse_trades(trades(spark, sf)))


def order_book(spark, sf):
    """Orders of every kind, valid and not, derived from the event stream."""
    e = table(spark, sf, "events")
    i, v = F.col("event_id"), F.col("value")
    d = F.when(i % 9 == 0, 0).when(i % 2 == 0, 1).otherwise(-1)
    kind = F.element_at(F.array(*[F.lit(x) for x in ("MARKET", "LIMIT", "STOP", "STOP_LIMIT")]), (i % 4 + 1).cast("int"))
    size = F.element_at(F.array(*[F.lit(x) for x in ("CONTRACTS", "DOLLARS", "PCT_RISK")]), (i % 3 + 1).cast("int"))
    return e.select(
        i.alias("entry_id"), F.col("event_type").alias("symbol"), "ts", d.alias("direction"), kind.alias("order_type"), size.alias("size_type"),
        F.when(i % 3 == 0, (i % 5) * 0.5).when(i % 3 == 1, 500.0).otherwise((i % 13) / 10.0).alias("size_value"), v.alias("ref_price"),
        F.when((i % 4).isin(1, 3) & (i % 17 != 0), v - d * (i % 6 - 1)).alias("limit_price"),
        F.when((i % 4).isin(2, 3) & (i % 19 != 0), v + d * (i % 5)).alias("stop_price"),
        F.when(i % 5 != 0, v - d * (i % 8)).alias("sl_price"), (v + d * (i % 10)).alias("tp_price"), F.when(i % 6 == 0, (i % 21) - 3.0).alias("trail_points"),
        F.when(i % 7 == 0, (i % 5) - 1.0).alias("trail_activation_points"))


cte("order_book", """SELECT event_id AS entry_id, event_type AS symbol, ts, d AS direction, CASE event_id % 4 WHEN 0 THEN 'MARKET' WHEN 1 THEN 'LIMIT' WHEN 2 THEN 'STOP' ELSE 'STOP_LIMIT' END AS order_type,
    CASE event_id % 3 WHEN 0 THEN 'CONTRACTS' WHEN 1 THEN 'DOLLARS' ELSE 'PCT_RISK' END AS size_type,
    CASE event_id % 3 WHEN 0 THEN (event_id % 5) * 0.5::DOUBLE WHEN 1 THEN 500.0 ELSE (event_id % 13) / 10.0::DOUBLE END AS size_value, value AS ref_price,
    CASE WHEN event_id % 4 IN (1, 3) AND event_id % 17 <> 0 THEN value - d * (event_id % 6 - 1) END AS limit_price,
    CASE WHEN event_id % 4 IN (2, 3) AND event_id % 19 <> 0 THEN value + d * (event_id % 5) END AS stop_price,
    CASE WHEN event_id % 5 <> 0 THEN value - d * (event_id % 8) END AS sl_price, value + d * (event_id % 10) AS tp_price, CASE WHEN event_id % 6 = 0 THEN event_id % 21 - 3.0::DOUBLE END AS trail_points, CASE WHEN event_id % 7 = 0 THEN event_id % 5 - 1.0::DOUBLE END AS trail_activation_points
    FROM (SELECT *, CASE WHEN event_id % 9 = 0 THEN 0 WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS d FROM events)""")


@query("order_sanity", "entry_id:i rule:s", "SELECT entry_id, rule FROM (" + " UNION ALL ".join(
    f"SELECT entry_id, '{n}' AS rule FROM order_book WHERE {c}" for n, c in (
        ("direction_not_unit", "direction NOT IN (1, -1)"), ("size_not_positive", "size_value <= 0"), ("stop_and_trail", "sl_price IS NOT NULL AND trail_points IS NOT NULL"),
        ("risk_size_without_stop", "size_type <> 'CONTRACTS' AND sl_price IS NULL AND trail_points IS NULL"),
        ("limit_price_missing", "order_type IN ('LIMIT', 'STOP_LIMIT') AND limit_price IS NULL"), ("stop_price_missing", "order_type IN ('STOP', 'STOP_LIMIT') AND stop_price IS NULL"),
        ("pct_out_of_range", "size_type = 'PCT_RISK' AND (size_value <= 0 OR size_value > 1)"), ("contracts_not_whole", "size_type = 'CONTRACTS' AND size_value <> floor(size_value)"),
        ("stop_wrong_side", "(sl_price - coalesce(limit_price, stop_price, ref_price)) * direction >= 0"),
        ("target_wrong_side", "(tp_price - coalesce(limit_price, stop_price, ref_price)) * direction <= 0"), ("stop_equals_target", "sl_price = tp_price"),
        ("trail_not_positive", "trail_points <= 0"), ("activation_without_trail", "trail_activation_points IS NOT NULL AND trail_points IS NULL"),
        ("activation_negative", "trail_points IS NOT NULL AND trail_activation_points < 0"),
        ("limit_wrong_side", "order_type = 'LIMIT' AND (limit_price - ref_price) * direction > 0"))) + ")")
def _(spark, sf):
    return order_book(spark, sf).select("entry_id", F.explode(T.order_violations()).alias("rule"))


@query("update_sanity", "entry_id:i rule:s", "SELECT entry_id, 'stop_crosses_target' AS rule FROM order_book WHERE direction * (tp_price - sl_price) <= 0")
def _(spark, sf):
    return order_book(spark, sf).select("entry_id", F.explode(T.update_violations()).alias("rule"))


@query("mirror_entries", "entry_id:i direction:i sl_price:r tp_price:r limit_price:r", """SELECT entry_id, -direction AS direction, 2 * coalesce(stop_price, limit_price) - sl_price AS sl_price,
    2 * coalesce(stop_price, limit_price) - tp_price AS tp_price, limit_price FROM order_book""")
def _(spark, sf):
    return T.mirror_entries(order_book(spark, sf))


@query("sltp_levels", "entry_id:i sl:r tp:r", """SELECT *, CASE tm WHEN 'risk_reward' THEN v + d * s * abs(v - sl) WHEN 'range_pct' THEN v + d * 30 * s / 100 WHEN 'atr_multiple' THEN v + d * 4 * s
    WHEN 'fixed_pct' THEN v * (1 + d * s / 100) ELSE v + d * s END AS tp FROM (SELECT entry_id, ref_price AS v, direction AS d, 1 + entry_id % 4 AS s,
      CASE entry_id % 5 WHEN 0 THEN ref_price - direction * 30 * (1 + entry_id % 4) / 100.0::DOUBLE WHEN 1 THEN ref_price - direction * 4 * (1 + entry_id % 4)
        WHEN 2 THEN ref_price * (1 - direction * (1 + entry_id % 4) / 100.0::DOUBLE) WHEN 3 THEN ref_price - direction * (1 + entry_id % 4)
        ELSE CASE WHEN direction = 1 THEN ref_price - 20 ELSE ref_price + 10 END END AS sl,
      CASE (entry_id // 5) % 5 WHEN 0 THEN 'risk_reward' WHEN 1 THEN 'range_pct' WHEN 2 THEN 'atr_multiple' WHEN 3 THEN 'fixed_pct' ELSE 'fixed_points' END AS tm FROM order_book)""")
def _(spark, sf):
    pick = lambda c, xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (c + 1).cast("int"))
    i = F.col("entry_id")
    d = order_book(spark, sf).withColumns({
        "sm": pick(i % 5, ("range_pct", "atr_multiple", "fixed_pct", "fixed_points", "opposite_range")), "size": (1 + i % 4).cast("double"), "atr": F.lit(4.0),
        "tm": pick(F.floor(i / 5) % 5, ("risk_reward", "range_pct", "atr_multiple", "fixed_pct", "fixed_points")),
        "hi": F.col("ref_price") + 10.0, "lo": F.col("ref_price") - 20.0})
    d = d.withColumn("sl", T.stop_level("sm", "ref_price", "direction", "size", "atr", "hi", "lo"))
    return d.withColumn("tp", T.target_level("tm", "ref_price", "direction", "size", "sl", "atr", "hi", "lo"))


@query("size_contracts", "trade_id:i n:i", """SELECT trade_id, CASE trade_id % 3 WHEN 0 THEN trade_id % 4 + 1 WHEN 1 THEN greatest(1, floor(500 / (abs(entry_price - initial_sl_price) * 20)))
    ELSE greatest(1, floor(100000 * 0.01::DOUBLE / (abs(entry_price - initial_sl_price) * 20))) END AS n FROM trades""")
def _(spark, sf):
    i = F.col("trade_id")
    kind = F.when(i % 3 == 0, "CONTRACTS").when(i % 3 == 1, "DOLLARS").otherwise("PCT_RISK")
    value = F.when(i % 3 == 0, (i % 4 + 1).cast("double")).when(i % 3 == 1, 500.0).otherwise(0.01)
    return trades(spark, sf).withColumn("n", T.contracts_for(kind, value, F.abs(F.col("entry_price") - F.col("initial_sl_price")), F.lit(100000.0)))


@query("size_minis_micros", "trade_id:i use_mini:b contracts:i net_pnl:r", """SELECT trade_id, m AS use_mini, c AS contracts, c * (pts * CASE WHEN m THEN 20 ELSE 2 END - CASE WHEN m THEN 3.5 ELSE 1.0 END) AS net_pnl FROM (
    SELECT *, least(greatest(floor(150 / (sl * CASE WHEN m THEN 20 ELSE 2 END)), 1), CASE WHEN m THEN 2 ELSE 20 END) AS c FROM (
    SELECT trade_id, (exit_price - entry_price) * direction AS pts, greatest(0.25, abs(entry_price - initial_sl_price)) AS sl, greatest(0.25, abs(entry_price - initial_sl_price)) * 20 <= 150 AS m FROM trades))""")
def _(spark, sf):
    d = trades(spark, sf)
    cols = T.sized_pnl((F.col("exit_price") - F.col("entry_price")) * F.col("direction"), F.abs(F.col("entry_price") - F.col("initial_sl_price")), F.lit(150.0), F.lit(2), F.lit(20))
    return d.select("trade_id", *[c.alias(n) for n, c in cols.items()])


@query("target_risk", "trade_id:i scheme:s risk:r", "SELECT trade_id, scheme, risk FROM (" + " UNION ALL ".join(
    f"SELECT trade_id, '{s}' AS scheme, {e} AS risk FROM (SELECT trade_id, 24000.0::DOUBLE + entry_price * 10 AS bal, entry_price > 40 AS won, 150.0::DOUBLE + trade_id % 300 AS prior FROM trades)" for s, e in (
        ("fixed_dollar", "200.0"), ("pct_balance", "bal * 200 / 25000"), ("frac_dd", "greatest(1, bal - 24000) * 0.2::DOUBLE"),
        ("floor_aware", "200 * least(2, greatest(0.25, 2 * greatest(1, bal - 24000) / 1000))"), ("max_size", "1e9"), ("martingale", "CASE WHEN won THEN 200 ELSE least(2 * prior, 800) END"))) + ")")
def _(spark, sf):
    schemes = ["fixed_dollar", "pct_balance", "frac_dd", "floor_aware", "max_size", "martingale"]
    d = trades(spark, sf).withColumn("scheme", F.explode(F.array(*[F.lit(s) for s in schemes])))
    return d.withColumn("risk", T.target_risk("scheme", F.lit(0.2), 24000.0 + F.col("entry_price") * 10, F.lit(24000.0), F.lit(25000.0), F.lit(1000.0), F.col("entry_price") > 40, 150.0 + F.col("trade_id") % 300))


@query("min_contracts_for_target_day", "trade_id:i minis:i micros:i day_risk:r", """SELECT trade_id, CASE WHEN pts > 0 AND NOT mf THEN nm ELSE 0 END AS minis, CASE WHEN pts > 0 AND mf THEN nu ELSE 0 END AS micros,
    CASE WHEN pts > 0 THEN coalesce(CASE WHEN mf THEN ru ELSE rm END, 0) ELSE 0 END AS day_risk FROM (SELECT *, rm IS NULL OR coalesce(ru <= rm, false) AS mf FROM (
      SELECT *, CASE WHEN m > 0 THEN nm * sl * 20 END AS rm, CASE WHEN u > 0 THEN nu * sl * 2 END AS ru FROM (
        SELECT *, CASE WHEN m > 0 THEN least(greatest(ceil(150 / m), 1), 4) ELSE 4 END AS nm, CASE WHEN u > 0 THEN least(greatest(ceil(150 / u), 1), 40) ELSE 40 END AS nu FROM (
          SELECT trade_id, pts, sl, pts * 20 - 3.5 AS m, pts * 2 - 1.0 AS u FROM (SELECT trade_id, (exit_price - entry_price) * direction AS pts, abs(entry_price - initial_sl_price) AS sl FROM trades)))))""")
def _(spark, sf):
    cols = T.winning_day_size((F.col("exit_price") - F.col("entry_price")) * F.col("direction"), F.abs(F.col("entry_price") - F.col("initial_sl_price")), F.lit(150.0), F.lit(40))
    return trades(spark, sf).select("trade_id", *[c.alias(n) for n, c in cols.items()])


@query("normalise_trades", "trade_id:i signed_points:r sl_distance:r", """SELECT trade_id, (exit_price - entry_price) * direction AS signed_points,
    greatest(coalesce(abs(entry_price - CASE WHEN trade_id % 3 <> 0 THEN initial_sl_price END), abs(mae_points)), 0.25) AS sl_distance FROM trades""")
def _(spark, sf):
    return T.normalised(trades(spark, sf).withColumn("initial_sl_price", F.when(F.col("trade_id") % 3 != 0, F.col("initial_sl_price"))))


@query("loss_penalty_target", "trade_id:i y:r", "SELECT trade_id, CASE WHEN r_multiple > 0 THEN r_multiple ELSE 1.5::DOUBLE * r_multiple END AS y FROM pnl")
def _(spark, sf):
    return pnl(spark, sf).withColumn("y", T.loss_penalty("r_multiple"))


@query("position_delta", "trade_id:i current:r close_contracts:r open_contracts:r", """SELECT *, CASE WHEN current * target < 0 THEN abs(current) ELSE greatest(abs(current) - abs(target), 0) END AS close_contracts,
    greatest(abs(target) - abs(current), 0) AS open_contracts FROM (SELECT *, coalesce(lag(target) OVER (PARTITION BY run_id ORDER BY entry_ts, trade_id), 0) AS current
      FROM (SELECT *, contracts * direction AS target FROM trades))""")
def _(spark, sf):
    d = trades(spark, sf).withColumn("target", F.col("contracts") * F.col("direction"))
    return framed(d, ["run_id"], ["entry_ts", "trade_id"], T.position_delta, before=1, block=hour_of("entry_ts"))


@query("scalar_prices", "trade_id:i tick:r up:r down:r ib:r lr:r mins:i dow:i ord:i", """SELECT trade_id, round(round_even(entry_price / 0.25, 0) * 0.25, 10) AS tick, ceil(entry_price / 0.25) * 0.25 AS up, floor(entry_price / 0.25) * 0.25 AS down,
    CASE WHEN greatest(entry_price, exit_price) + 1 - least(entry_price, exit_price) > 0 THEN (exit_price - least(entry_price, exit_price)) / (greatest(entry_price, exit_price) + 1 - least(entry_price, exit_price)) ELSE 0.5 END AS ib,
    ln(exit_price / entry_price) AS lr, hour(entry_ts) * 60 + minute(entry_ts) AS mins, isodow(entry_ts) - 1 AS dow, date_diff('day', DATE '1970-01-01', CAST(entry_ts AS DATE)) AS ord FROM trades""")
def _(spark, sf):
    lo, hi = F.least("entry_price", "exit_price"), F.greatest("entry_price", "exit_price") + 1
    return trades(spark, sf).select(
        "trade_id", S.round_to_tick("entry_price").alias("tick"), S.round_up("entry_price").alias("up"), S.round_down("entry_price").alias("down"),
        S.ibs(hi, lo, F.col("exit_price")).alias("ib"), S.ieee_ln(S.ieee_div("exit_price", "entry_price")).alias("lr"),
        S.minute_of_day("entry_ts").alias("mins"), S.weekday_mon0("entry_ts").alias("dow"), S.day_ordinal("entry_ts").alias("ord"))


_fib_rows = [("OTE", v) for v in S.OTE_RATIOS] + [("STDV", v) for v in S.STDV_MULTIPLES]


@query("fib_levels", "trade_id:i type:s value:r price:r direction:i", "SELECT trade_id, t AS type, v AS value, CASE WHEN t = 'OTE' THEN CASE WHEN d = 1 THEN hi ELSE lo END ELSE CASE WHEN d = 1 THEN lo ELSE hi END END - d * v * (hi - lo) AS price, -d AS direction FROM "
       "(SELECT trade_id, direction AS d, least(entry_price, exit_price) AS lo, greatest(entry_price, exit_price) AS hi FROM trades), (VALUES "
       + ", ".join(f"('{t}', {v}::DOUBLE)" for t, v in _fib_rows) + ") f(t, v) WHERE hi > lo")
def _(spark, sf):
    lo, hi = F.least("entry_price", "exit_price"), F.greatest("entry_price", "exit_price")
    return trades(spark, sf).select("trade_id", F.inline(S.fib_levels(lo, hi, "direction")))


@query("zone_levels", "trade_id:i pos:i price:r", """SELECT trade_id, p AS pos, CASE p WHEN 0 THEN n WHEN 1 THEN (n + f) / 2 WHEN 2 THEN f WHEN 3 THEN n + 0.5 * abs(f - n) WHEN 4 THEN n + 0.618::DOUBLE * abs(f - n)
    WHEN 5 THEN n + 0.705::DOUBLE * abs(f - n) ELSE n + 0.79::DOUBLE * abs(f - n) END AS price FROM (SELECT trade_id, entry_price AS n, exit_price AS f FROM trades), range(0, 7) r(p) WHERE p < 3 OR trade_id % 2 = 0""")
def _(spark, sf):
    kind = F.when(F.col("trade_id") % 2 == 0, "RB").otherwise("OB")
    lv = S.zone_levels(kind, "entry_price", "exit_price", "entry_price", "exit_price")
    return trades(spark, sf).select("trade_id", F.posexplode(lv).alias("pos", "price"))


@query("report_format", "trade_id:i pct:s dollar:s number:s label:s", """SELECT trade_id, printf('%.1f', r_multiple / 3 * 100) || '%' AS pct, CASE WHEN contracts * direction < 0 THEN '-' ELSE '' END || '$' || CAST(contracts::BIGINT AS VARCHAR) AS dollar,
    printf('%.2f', entry_price) AS number, 'dir=' || direction || ' size=' || contracts::BIGINT AS label FROM pnl""")
def _(spark, sf):
    n = F.col("contracts").cast("bigint")
    return pnl(spark, sf).select("trade_id", S.fmt_pct(F.col("r_multiple") / 3).alias("pct"), S.fmt_dollar(F.col("contracts") * F.col("direction")).alias("dollar"),
                                 S.fmt_number("entry_price").alias("number"), S.config_label([("dir", F.col("direction")), ("size", n)]).alias("label"))


@query("json_extract", "event_id:i k:r", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", S.json_number("props", "k").alias("k"))


@query("months_arithmetic", "o_orderkey:i later:d before:d", "SELECT o_orderkey, CAST(o_orderdate AS DATE) + INTERVAL 3 MONTH AS later, CAST(o_orderdate AS DATE) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS before FROM orders")
def _(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", S.add_months_clamped(F.to_date("o_orderdate"), 3).alias("later"))
    return d.withColumn("before", F.date_sub("later", 1))


@query("params_hash", "p_partkey:i h:s m:s", """SELECT p_partkey, substr(sha256(j), 1, 16) AS h, substr(md5(j), 1, 12) AS m FROM (SELECT p_partkey, '{"brand":"' || p_brand || '","size":"' || p_size || '"}' AS j FROM part)""")
def _(spark, sf):
    params = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"))
    return table(spark, sf, "part").select("p_partkey", S.params_hash(params).alias("h"), S.params_hash(params, "md5").alias("m"))


# --- performance -------------------------------------------------------------------------------------

SUMMARY = "n_trades:i win_rate:r avg_win:r avg_loss:r avg_trade:r payoff:r profit_factor:r expectancy_r:r largest_win:r largest_loss:r net_pnl:r commission:r slippage:r"


def _summary_sql(source: str, by: str) -> str:
    return f"""SELECT {by}, count(*) AS n_trades, count(*) FILTER (net > 0) / count(*) AS win_rate, coalesce(avg(net) FILTER (net > 0), 0) AS avg_win, coalesce(avg(net) FILTER (net < 0), 0) AS avg_loss, avg(net) AS avg_trade,
    coalesce(coalesce(avg(net) FILTER (net > 0), 0) / abs(avg(net) FILTER (net < 0)), 'inf'::DOUBLE) AS payoff, coalesce(coalesce(sum(net) FILTER (net > 0), 0) / abs(sum(net) FILTER (net < 0)), 'inf'::DOUBLE) AS profit_factor,
    coalesce(avg(net) / abs(avg(net) FILTER (net < 0)), 'inf'::DOUBLE) AS expectancy_r, max(net) AS largest_win, min(net) AS largest_loss, sum(net) AS net_pnl, sum(commission_paid) AS commission, sum(slippage_paid) AS slippage
    FROM {source} GROUP BY {by}"""


@query("trade_summary", "run_id:i " + SUMMARY, _summary_sql("pnl", "run_id"))
def _(spark, sf):
    return P.trade_summary(pnl(spark, sf), ["run_id"])


@query("exit_breakdown", "exit_reason:s n:i win_rate:r avg_pnl:r total_pnl:r", "SELECT exit_reason, count(*) AS n, avg((net > 0)::INT) AS win_rate, avg(net) AS avg_pnl, sum(net) AS total_pnl FROM pnl GROUP BY 1")
def _(spark, sf):
    return P.breakdown(pnl(spark, sf), ["exit_reason"])


@query("hourly_breakdown", "hour:i n:i win_rate:r avg_pnl:r total_pnl:r", "SELECT hour(entry_ts) AS hour, count(*) AS n, avg((net > 0)::INT) AS win_rate, avg(net) AS avg_pnl, sum(net) AS total_pnl FROM pnl GROUP BY 1")
def _(spark, sf):
    return P.breakdown(pnl(spark, sf), [F.hour("entry_ts").alias("hour")])


@query("bulk_breakdown", "reason:s n:i win_rate:r avg_pnl:r total_pnl:r", """SELECT l_returnflag || l_linestatus AS reason, count(*) AS n, avg((p > 0)::INT) AS win_rate, avg(p) AS avg_pnl, sum(p) AS total_pnl
    FROM (SELECT *, l_extendedprice * (0.05::DOUBLE - l_discount) - l_tax AS p FROM lineitem) GROUP BY 1""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("reason"), (F.col("l_extendedprice") * (0.05 - F.col("l_discount")) - F.col("l_tax")).alias("net_pnl_dollars"))
    return P.breakdown(li, ["reason"])


cte("eq", """SELECT *, equity - peak AS dd, (equity - peak) / CASE WHEN peak = 0 THEN 1 ELSE peak END AS dd_pct FROM (SELECT *, greatest(5000.0::DOUBLE, max(equity) OVER w) AS peak FROM (
    SELECT *, 5000.0::DOUBLE + sum(net) OVER w AS equity FROM pnl WINDOW w AS (PARTITION BY run_id ORDER BY exit_ts, trade_id)) WINDOW w AS (PARTITION BY run_id ORDER BY exit_ts, trade_id))""")


def equity(spark, sf):
    return P.equity_curve(pnl(spark, sf), ["run_id"], ["exit_ts", "trade_id"], "net_pnl_dollars", 5000.0)


@query("equity_and_drawdown", "run_id:i trade_id:i equity:r peak:r dd:r dd_pct:r", "SELECT * FROM eq")
def _(spark, sf):
    return equity(spark, sf)


@query("drawdown_stats", "run_id:i max_dd:r max_dd_pct:r avg_dd_pct:r longest_rows:i", """SELECT run_id, min(mdd) AS max_dd, min(mp) AS max_dd_pct, coalesce(sum(s) / nullif(sum(len), 0), 0) AS avg_dd_pct, max(len) AS longest_rows FROM (
    SELECT run_id, g, min(dd) AS mdd, min(dd_pct) AS mp, sum(dd_pct) FILTER (dd < -1e-9) AS s, count(*) FILTER (dd < -1e-9) AS len FROM (
      SELECT *, count(*) FILTER (dd >= -1e-9) OVER (PARTITION BY run_id ORDER BY exit_ts, trade_id) AS g FROM eq) GROUP BY 1, 2) GROUP BY 1""")
def _(spark, sf):
    return P.drawdown_stats(equity(spark, sf), ["run_id"], ["exit_ts", "trade_id"])


@query("streaks", "run_id:i win_streak:i loss_streak:i", """SELECT run_id, coalesce(max(n) FILTER (win), 0) AS win_streak, coalesce(max(n) FILTER (NOT win), 0) AS loss_streak FROM (
    SELECT run_id, net > 0 AS win, rn - rk AS g, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY exit_ts, trade_id) AS rn,
      row_number() OVER (PARTITION BY run_id, net > 0 ORDER BY exit_ts, trade_id) AS rk FROM pnl) GROUP BY 1, 2, 3) GROUP BY 1""")
def _(spark, sf):
    return P.streaks(pnl(spark, sf), ["run_id"], ["exit_ts", "trade_id"])


cte("cal", "SELECT DISTINCT CAST(ts AS DATE) AS date FROM bars WHERE hour(ts) * 60 + minute(ts) BETWEEN 570 AND 1020")
cte("dpnl", "SELECT run_id, CAST(exit_ts AS DATE) AS date, sum(net) AS pnl, count(*) AS n FROM pnl GROUP BY 1, 2")
cte("on_cal", """SELECT run_id, date, sum(pnl) AS pnl FROM (SELECT d.run_id, coalesce((SELECT min(c.date) FROM cal c WHERE c.date >= d.date), (SELECT max(c.date) FROM cal c)) AS date, d.pnl FROM dpnl d) GROUP BY 1, 2""")
cte("dense_pnl", "SELECT r.run_id, c.date, coalesce(d.pnl, 0) AS pnl FROM (SELECT DISTINCT run_id FROM pnl) r CROSS JOIN cal c LEFT JOIN on_cal d ON d.run_id = r.run_id AND d.date = c.date")


@query("daily_pnl", "run_id:i date:d pnl:r n:i", "SELECT * FROM dpnl")
def _(spark, sf):
    return P.daily_pnl(pnl(spark, sf), ["run_id"])


cte("ratios", """SELECT run_id, count(*) AS n_days, sum(pnl) AS total, CASE WHEN stddev_pop(pnl) > 0 THEN avg(pnl) / stddev_pop(pnl) * sqrt(252) ELSE 0 END AS sharpe,
    CASE WHEN count(*) FILTER (pnl < 0) >= 2 AND stddev_pop(pnl) FILTER (pnl < 0) > 0 THEN avg(pnl) / stddev_pop(pnl) FILTER (pnl < 0) * sqrt(252) ELSE 0 END AS sortino,
    CASE WHEN 100000 + sum(pnl) <= 0 THEN -1 ELSE pow((100000 + sum(pnl)) / 100000, 252.0 / count(*)) - 1 END AS cagr FROM dense_pnl GROUP BY run_id""")


@query("risk_ratios", "run_id:i n_days:i total:r sharpe:r sortino:r cagr:r", "SELECT * FROM ratios")
def _(spark, sf):
    return P.risk_ratios(P.daily_pnl(pnl(spark, sf), ["run_id"]), B.trading_calendar(bars(spark, sf)), ["run_id"], 100000.0)


@query("calmar", "run_id:i calmar:r", "SELECT r.run_id, coalesce(cagr / nullif(abs(m), 0), 'inf'::DOUBLE) AS calmar FROM ratios r JOIN (SELECT run_id, min(dd_pct) AS m FROM eq GROUP BY 1) d USING (run_id)")
def _(spark, sf):
    p = pnl(spark, sf)
    ratios = P.risk_ratios(P.daily_pnl(p, ["run_id"]), B.trading_calendar(bars(spark, sf)), ["run_id"], 100000.0)
    dd = equity(spark, sf).groupBy("run_id").agg(F.min("dd_pct").alias("max_dd_pct"))
    return P.with_calmar(ratios, dd, ["run_id"])


@query("mae_mfe", "trade_id:i mae:r mfe:r", """SELECT t.trade_id, greatest(0, coalesce(CASE WHEN any_value(direction) = 1 THEN (any_value(entry_price) - min(b.low)) / any_value(entry_price) ELSE (max(b.high) - any_value(entry_price)) / any_value(entry_price) END, 0)) AS mae,
    greatest(0, coalesce(CASE WHEN any_value(direction) = 1 THEN (max(b.high) - any_value(entry_price)) / any_value(entry_price) ELSE (any_value(entry_price) - min(b.low)) / any_value(entry_price) END, 0)) AS mfe
    FROM trades t LEFT JOIN bars b ON b.symbol = t.symbol AND b.ts BETWEEN t.entry_ts AND t.exit_ts GROUP BY t.trade_id""")
def _(spark, sf):
    return P.mae_mfe(trades(spark, sf), bars(spark, sf), ["symbol"], "trade_id", "entry_ts", "exit_ts")


@query("trade_bar_range_join", "trade_id:i n_bars:i vol:r", "SELECT t.trade_id, count(*) AS n_bars, sum(b.volume) AS vol FROM trades t JOIN bars b ON b.symbol = t.symbol AND b.ts BETWEEN t.entry_ts AND t.exit_ts GROUP BY 1")
def _(spark, sf):
    t = trades(spark, sf).select("trade_id", "symbol", "entry_ts", "exit_ts")
    d = interval_join(t, bars(spark, sf), ["symbol"], "entry_ts", "exit_ts", "ts", salts=4)
    return d.groupBy("trade_id").agg(F.count(F.lit(1)).alias("n_bars"), F.sum("volume").alias("vol"))


@query("buy_hold_fixed", "symbol ts equity:r", "SELECT symbol, ts, 100000 - 2 + (close - first_value(open) OVER (PARTITION BY symbol ORDER BY ts) - 0.25) * 20 AS equity FROM bars")
def _(spark, sf):
    return P.buy_hold_fixed(bars(spark, sf), ["symbol"], 100000.0, 0.25, 2.0)


_compounding = """WITH RECURSIVE o AS (SELECT symbol, CAST(ts AS DATE) AS date, arg_min(open, ts) AS o FROM bars GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n FROM o),
    f AS (SELECT symbol, date, n, floor(100000.0::DOUBLE / (o * 20)) AS h, floor(100000.0::DOUBLE / (o * 20)) * (o + {s}) AS c FROM k WHERE n = 1
      UNION ALL SELECT k.symbol, k.date, k.n, greatest(f.h, floor((100000.0::DOUBLE - {m} * f.h) / (k.o * 20))), f.c + (greatest(f.h, floor((100000.0::DOUBLE - {m} * f.h) / (k.o * 20))) - f.h) * (k.o + {s}) FROM f JOIN k ON k.symbol = f.symbol AND k.n = f.n + 1)
    SELECT b.symbol, b.ts, 100000.0::DOUBLE - {m} * h + (b.close * h - c) * 20 AS equity FROM bars b JOIN f ON f.symbol = b.symbol AND f.date = CAST(b.ts AS DATE)"""


@query("buy_hold_compounding", "symbol ts equity:r", _compounding.format(s="0.25::DOUBLE", m="2.0::DOUBLE"))
def _(spark, sf):
    return P.buy_hold_compounding(bars(spark, sf), ["symbol"], 100000.0, 0.25, 2.0)


def _curve(source: str) -> str:
    """SQL of the P&L, CAGR, Sharpe and deepest drawdown of a curve of equity from 100,000."""
    return f"""SELECT symbol, arg_max(eod, date) - 100000 AS pnl, CASE WHEN arg_max(eod, date) <= 0 THEN -1 ELSE pow(arg_max(eod, date) / 100000.0::DOUBLE, 252.0::DOUBLE / count(*)) - 1 END AS cagr,
      CASE WHEN stddev_pop(chg) > 0 THEN avg(chg) / stddev_pop(chg) * sqrt(252) ELSE 0 END AS sharpe, least(0, min(dd)) AS max_dd_pct
      FROM (SELECT *, eod - lag(eod, 1, 100000.0::DOUBLE) OVER (PARTITION BY symbol ORDER BY date) AS chg FROM (
        SELECT symbol, CAST(ts AS DATE) AS date, arg_max(equity, ts) AS eod, min((equity - peak) / peak) AS dd FROM (SELECT *, greatest(100000.0::DOUBLE, max(equity) OVER (PARTITION BY symbol ORDER BY ts)) AS peak FROM ({source})) GROUP BY 1, 2)) GROUP BY 1"""


_benchmarks = f"""WITH f AS ({_curve("SELECT symbol, ts, 100000.0::DOUBLE + (close - first_value(open) OVER (PARTITION BY symbol ORDER BY ts)) * 20 AS equity FROM bars")}),
    c AS ({_curve(_compounding.format(s="0.0::DOUBLE", m="0.0::DOUBLE"))}),
    d AS (SELECT symbol, coalesce((SELECT min(c.date) FROM cal c WHERE c.date >= x.date), (SELECT max(c.date) FROM cal c)) AS date, x.pnl FROM (SELECT symbol, CAST(exit_ts AS DATE) AS date, sum(net) AS pnl FROM pnl GROUP BY 1, 2) x),
    e AS (SELECT s.symbol, k.date, coalesce(sum(d.pnl), 0) AS pnl FROM (SELECT DISTINCT symbol FROM pnl) s CROSS JOIN cal k LEFT JOIN d ON d.symbol = s.symbol AND d.date = k.date GROUP BY 1, 2),
    p AS (SELECT *, greatest(100000.0::DOUBLE, max(equity) OVER (PARTITION BY symbol ORDER BY exit_ts, trade_id)) AS peak FROM (SELECT symbol, exit_ts, trade_id, 100000.0::DOUBLE + sum(net) OVER (PARTITION BY symbol ORDER BY exit_ts, trade_id) AS equity FROM pnl)),
    o AS (SELECT e.symbol, sum(e.pnl) AS pnl, CASE WHEN 100000 + sum(e.pnl) <= 0 THEN -1 ELSE pow((100000 + sum(e.pnl)) / 100000, 252.0::DOUBLE / count(*)) - 1 END AS cagr, CASE WHEN stddev_pop(e.pnl) > 0 THEN avg(e.pnl) / stddev_pop(e.pnl) * sqrt(252) ELSE 0 END AS sharpe,
      (SELECT min((equity - peak) / peak) FROM p WHERE p.symbol = e.symbol) AS max_dd_pct FROM e GROUP BY 1),
    a AS (SELECT symbol, m AS metric, v AS x, w FROM (SELECT 'o' AS w, * FROM o UNION ALL SELECT 'f', * FROM f UNION ALL SELECT 'c', * FROM c) t,
      LATERAL (VALUES ('pnl', t.pnl), ('cagr', t.cagr), ('sharpe', t.sharpe), ('max_dd_pct', t.max_dd_pct), ('calmar', CASE WHEN t.max_dd_pct <> 0 THEN t.cagr / abs(t.max_dd_pct) ELSE 0 END)) r(m, v)),
    b AS (SELECT symbol, metric, max(x) FILTER (w = 'o') AS strategy, max(x) FILTER (w = 'f') AS fixed, max(x) FILTER (w = 'c') AS compounding FROM a GROUP BY 1, 2)
    SELECT *, CASE WHEN strategy > greatest(fixed, compounding) THEN 'better' WHEN strategy > least(fixed, compounding) THEN 'between' ELSE 'worse' END AS verdict FROM b
    UNION ALL SELECT symbol, 'alpha_fixed', strategy - fixed, NULL, NULL, CASE WHEN strategy > fixed THEN 'better' ELSE 'worse' END FROM b WHERE metric = 'cagr'
    UNION ALL SELECT symbol, 'alpha_compounding', strategy - compounding, NULL, NULL, CASE WHEN strategy > compounding THEN 'better' ELSE 'worse' END FROM b WHERE metric = 'cagr'"""


@query("benchmark_compare", "symbol metric:s strategy:r fixed:r compounding:r verdict:s", _benchmarks)
def _(spark, sf):
    b = bars(spark, sf)
    fixed = P.curve_stats(P.buy_hold_fixed(b, ["symbol"], 100000.0), ["symbol"], 100000.0)
    comp = P.curve_stats(P.buy_hold_compounding(b, ["symbol"], 100000.0), ["symbol"], 100000.0)
    p = pnl(spark, sf)
    dd = P.equity_curve(p, ["symbol"], ["exit_ts", "trade_id"], "net_pnl_dollars", 100000.0).groupBy("symbol").agg(F.min("dd_pct").alias("max_dd_pct"))
    own = P.risk_ratios(P.daily_pnl(p, ["symbol"]), B.trading_calendar(b), ["symbol"], 100000.0).join(dd, "symbol")
    return P.benchmark_compare(own.select("symbol", F.col("total").alias("pnl"), "cagr", "sharpe", "max_dd_pct"), fixed, comp, ["symbol"])


@query("histogram", "symbol bin:i center:r n:i", """WITH s AS (SELECT symbol, min(net) AS lo, (max(net) - min(net)) / 20 AS w FROM pnl GROUP BY 1)
    SELECT s.symbol, b AS bin, lo + (b + 0.5) * w AS center, (SELECT count(*) FROM pnl p WHERE p.symbol = s.symbol AND least(19, floor((p.net - s.lo) / s.w)) = b) AS n FROM s, range(0, 20) r(b)""")
def _(spark, sf):
    return P.histogram(pnl(spark, sf), ["symbol"], "net_pnl_dollars", 20)


@query("downsample_curve", "symbol idx:i close:r", """WITH c AS (SELECT symbol, max(n) AS m FROM nbars GROUP BY 1), i AS (SELECT DISTINCT symbol, CASE WHEN k = 99 THEN m - 1 ELSE floor(k * ((m - 1) / 99.0::DOUBLE)) END AS idx FROM c, range(0, 100) r(k))
    SELECT b.symbol, b.n - 1 AS idx, b.close FROM nbars b JOIN i ON i.symbol = b.symbol AND i.idx = b.n - 1""")
def _(spark, sf):
    return P.downsample(bars(spark, sf), ["symbol"], ["ts"], 100)


@query("representative_trades", "run_id:i winner:b trade_id:i net_pnl_dollars:r", """SELECT run_id, winner, trade_id, net AS net_pnl_dollars FROM (SELECT *, row_number() OVER (PARTITION BY run_id, winner ORDER BY -abs(net), trade_id) AS rn,
    count(*) OVER (PARTITION BY run_id, winner) AS c FROM (SELECT *, net > 0 AS winner, max((sl_price IS NOT NULL)::INT) OVER (PARTITION BY run_id) AS any_sl FROM pnl) WHERE any_sl = 0 OR sl_price IS NOT NULL) WHERE rn - 1 = c // 3""")
def _(spark, sf):
    return P.representative_trades(pnl(spark, sf), ["run_id"])


def positioned(spark, sf):
    """Trades with the positions of their entry and exit bars, and the bars with theirs."""
    b = with_ordinal(bars(spark, sf), ["symbol"], ["ts"], F.date_trunc("day", "ts"))
    pos = b.select("symbol", F.col("ts").alias("b_ts"), F.col("ord").alias("o"))
    t = trades(spark, sf).select("trade_id", "symbol", "entry_ts", "exit_ts")
    t = asof_join(t, pos, ["symbol"], "entry_ts", "b_ts", ["o"]).withColumnRenamed("o", "entry_ord")
    t = asof_join(t, pos, ["symbol"], "exit_ts", "b_ts", ["o"]).withColumnRenamed("o", "exit_ord")
    return t.where("entry_ord is not null"), b


@query("trade_windows", "trade_id:i n:i entry_index:i exit_index:i close_sum:r", """WITH t AS (SELECT t.trade_id, t.symbol, max(b.n) FILTER (b.ts <= t.entry_ts) AS e, max(b.n) FILTER (b.ts <= t.exit_ts) AS x FROM trades t JOIN nbars b ON b.symbol = t.symbol AND b.ts <= t.exit_ts GROUP BY 1, 2)
    SELECT trade_id, count(*) AS n, any_value(e) - min(b.n) AS entry_index, any_value(x) - min(b.n) AS exit_index, sum(b.close) AS close_sum FROM t JOIN nbars b ON b.symbol = t.symbol AND b.n BETWEEN greatest(1, e - 25) AND x + 25 GROUP BY 1""")
def _(spark, sf):
    t, b = positioned(spark, sf)
    d = X.trade_windows(t, b, 25, columns=["close"])
    return d.select("trade_id", F.size("window").alias("n"), "entry_index", "exit_index", F.aggregate("window", F.lit(0.0), lambda a, x: a + x["close"]).alias("close_sum"))


@query("trade_window_pieces", "trade_id:i piece:i place:i n:i entry_index:i exit_index:i first_close:r last_close:r", """WITH t AS (SELECT t.trade_id, t.symbol, max(b.n) FILTER (b.ts <= t.entry_ts) AS e, max(b.n) FILTER (b.ts <= t.exit_ts) AS x FROM trades t JOIN nbars b ON b.symbol = t.symbol AND b.ts <= t.exit_ts GROUP BY 1, 2), w AS (
    SELECT trade_id, b.n, b.close, greatest(1, e - 25) AS lo, e, x FROM t JOIN nbars b ON b.symbol = t.symbol AND b.n BETWEEN greatest(1, e - 25) AND x + 25)
    SELECT trade_id, n // 64 AS piece, min(n) - any_value(lo) AS place, count(*) AS n, any_value(e - lo) AS entry_index, any_value(x - lo) AS exit_index, arg_min(close, n) AS first_close, arg_max(close, n) AS last_close FROM w GROUP BY trade_id, n // 64""")
def _(spark, sf):
    t, b = positioned(spark, sf)
    d = X.trade_window_pieces(t, b, 25, size=64, columns=["close"])
    return d.select("trade_id", "piece", "place", F.size("window").alias("n"), "entry_index", "exit_index", F.element_at("window", 1)["close"].alias("first_close"), F.element_at("window", -1)["close"].alias("last_close"))


# --- exits -------------------------------------------------------------------------------------------

cte("entries", """SELECT symbol, ts, cross_ AS direction, close AS entry_price, close - cross_ * 20 AS sl_price, close + cross_ * 30 AS tp_price, ts + INTERVAL 12 HOUR AS end_ts FROM sma WHERE cross_ <> 0""")
cte("touch", """SELECT e.*, b.ts AS b_ts, b.close AS b_close, CASE WHEN (e.direction = 1 AND b.open <= sl_price) OR (e.direction = -1 AND b.open >= sl_price) THEN 'SL'
    WHEN (e.direction = 1 AND b.open >= tp_price) OR (e.direction = -1 AND b.open <= tp_price) THEN 'TP' WHEN (e.direction = 1 AND b.low <= sl_price) OR (e.direction = -1 AND b.high >= sl_price) THEN 'SL'
    WHEN (e.direction = 1 AND b.high >= tp_price) OR (e.direction = -1 AND b.low <= tp_price) THEN 'TP' END AS reason,
    CASE WHEN (e.direction = 1 AND (b.open <= sl_price OR b.open >= tp_price)) OR (e.direction = -1 AND (b.open >= sl_price OR b.open <= tp_price)) THEN b.open
    WHEN e.direction = 1 AND b.low <= sl_price THEN least(b.open, sl_price) WHEN e.direction = -1 AND b.high >= sl_price THEN greatest(b.open, sl_price) ELSE tp_price END AS price
    FROM entries e LEFT JOIN bars b ON b.symbol = e.symbol AND b.ts > e.ts AND b.ts <= e.end_ts""")
cte("exits", """SELECT symbol, ts, direction, entry_price, sl_price, tp_price, coalesce(min(b_ts) FILTER (reason IS NOT NULL), max(b_ts)) AS exit_ts,
    coalesce(arg_min(price, b_ts) FILTER (reason IS NOT NULL), arg_max(b_close, b_ts)) AS exit_price, coalesce(arg_min(reason, b_ts) FILTER (reason IS NOT NULL), CASE WHEN max(b_ts) IS NOT NULL THEN 'EOD' END) AS exit_reason
    FROM touch GROUP BY 1, 2, 3, 4, 5, 6""")
cte("funnel", """SELECT *, (exit_price - entry_price) * direction * 20 - 10 - 4 AS net, 4.0::DOUBLE AS commission_paid, 10.0::DOUBLE AS slippage_paid FROM exits WHERE exit_ts IS NOT NULL""")


def cross_entries(spark, sf):
    c = F.col("cross")
    d = I.sma_cross(bars(spark, sf), 5, 20).where(c != 0)
    return d.select(F.concat_ws("|", "symbol", "ts").alias("entry_id"), "symbol", "ts", c.alias("direction"), F.col("close").alias("entry_price"),
                    (F.col("close") - c * 20).alias("sl_price"), (F.col("close") + c * 30).alias("tp_price"), (F.col("ts") + F.expr("INTERVAL 12 HOURS")).alias("end_ts"))


@query("first_touch_exit", "symbol ts direction:i exit_ts exit_price:r exit_reason:s", "SELECT * FROM exits")
def _(spark, sf):
    return X.first_touch_exit(cross_entries(spark, sf), bars(spark, sf))


@query("trade_funnel", "symbol " + SUMMARY, _summary_sql("funnel", "symbol"))
def _(spark, sf):
    closed = X.first_touch_exit(cross_entries(spark, sf), bars(spark, sf)).where(F.col("exit_ts").isNotNull())
    lit = lambda x: F.lit(x)
    t = closed.withColumns({"entry_ts": F.col("ts"), "contracts": lit(1.0), "slippage_points": lit(0.25), "commission_per_contract": lit(2.0),
                            "initial_sl_price": F.col("sl_price"), "mae_points": lit(0.0), "mfe_points": lit(0.0)})
    return P.trade_summary(T.with_trade_pnl(t), ["symbol"])


cte("resting", """SELECT symbol, ts, n AS placed, CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END AS direction, CASE n % 3 WHEN 0 THEN 'LIMIT' WHEN 1 THEN 'STOP' ELSE 'STOP_LIMIT' END AS order_type, close AS c FROM nbars WHERE n % 5 = 0""")
cte("rest2", """SELECT *, CASE WHEN order_type <> 'STOP' THEN round_even((c - direction * 8) / 0.25, 0) * 0.25 END AS limit_price, CASE WHEN order_type <> 'LIMIT' THEN round_even((c + direction * 6) / 0.25, 0) * 0.25 END AS stop_price,
    CASE WHEN direction = 1 THEN c + 60 END AS cancel_above, CASE WHEN direction = -1 THEN c - 60 END AS cancel_below FROM resting""")


def resting_orders(spark, sf):
    b = with_ordinal(bars(spark, sf), ["symbol"], ["ts"], F.date_trunc("day", "ts"))
    n, c = F.col("ord"), F.col("close")
    d = F.when(n % 2 == 0, 1).otherwise(-1)
    kind = F.when(n % 3 == 0, "LIMIT").when(n % 3 == 1, "STOP").otherwise("STOP_LIMIT")
    o = b.where(n % 5 == 0).select(
        F.concat_ws("|", "symbol", "ts").alias("entry_id"), "symbol", "ts", n.alias("placed"), F.lit(10).alias("expiry_bars"), d.alias("direction"), kind.alias("order_type"),
        F.when(kind != "STOP", c - d * 8).alias("limit_price"), F.when(kind != "LIMIT", c + d * 6).alias("stop_price"), (c - d * 25).alias("sl_price"), (c + d * 60).alias("tp_price"),
        F.when(d == 1, c + 60).alias("cancel_above"), F.when(d == -1, c - 60).alias("cancel_below"))
    # Prices an order sends are already on the tick grid.
    return o.withColumns({"limit_price": S.round_to_tick("limit_price"), "stop_price": S.round_to_tick("stop_price")}), b


def _pending(session_end: str) -> str:
    return f"""WITH p AS (SELECT o.symbol, o.ts, b.n, b.ts AS b_ts,
      {session_end} OR coalesce((b.high >= cancel_above AND b.low > limit_price) OR (b.low <= cancel_below AND b.high < limit_price), false) AS gone,
      CASE order_type WHEN 'LIMIT' THEN CASE WHEN (direction = 1 AND b.low <= limit_price) OR (direction = -1 AND b.high >= limit_price) THEN limit_price END
        WHEN 'STOP' THEN CASE WHEN direction = 1 AND b.high >= stop_price THEN round_even(greatest(b.open, stop_price) / 0.25, 0) * 0.25 WHEN direction = -1 AND b.low <= stop_price THEN round_even(least(b.open, stop_price) / 0.25, 0) * 0.25 END
        ELSE CASE WHEN (direction = 1 AND b.high >= stop_price AND b.low <= limit_price) OR (direction = -1 AND b.low <= stop_price AND b.high >= limit_price) THEN limit_price END END AS fp
      FROM rest2 o LEFT JOIN nbars b ON b.symbol = o.symbol AND b.n BETWEEN o.placed + 1 AND o.placed + 9),
    f AS (SELECT symbol, ts, arg_min({{'g': gone, 't': b_ts, 'p': fp}}, n) FILTER (gone OR fp IS NOT NULL) AS x FROM p GROUP BY 1, 2)
    SELECT symbol, ts, CASE WHEN x IS NULL THEN 'EXPIRED' WHEN x.g THEN 'CANCELLED' ELSE 'FILLED' END AS status, CASE WHEN NOT x.g THEN x.t END AS fill_ts, CASE WHEN NOT x.g THEN x.p END AS fill_price FROM f"""


@query("pending_fill", "symbol ts status:s fill_ts fill_price:r", _pending("false"))
def _(spark, sf):
    orders, b = resting_orders(spark, sf)
    return X.pending_fill(orders, b)


@query("pending_fill_session_end", "symbol ts status:s fill_ts fill_price:r", _pending("coalesce(hour(b.ts) * 60 + minute(b.ts) >= 660, false)"))
def _(spark, sf):
    orders, b = resting_orders(spark, sf)
    return X.pending_fill(orders, b, session_end=660)


cte("upd", """SELECT trade_id, direction, entry_price AS price, sl_price, tp_price, round_even((entry_price - direction * (trade_id % 9 - 2)) / 0.25, 0) * 0.25 AS nsl,
    CASE WHEN trade_id % 4 <> 0 THEN round_even((entry_price + direction * (trade_id % 12 - 3)) / 0.25, 0) * 0.25 END AS ntp FROM trades""")


@query("forced_exit_check", "trade_id:i action:s sl_after:r tp_after:r exit_price:r", """SELECT trade_id, a AS action, CASE WHEN crossed OR slp THEN sl_price WHEN direction = 1 THEN greatest(sl_price, nsl) ELSE least(sl_price, nsl) END AS sl_after,
    CASE WHEN a = 'APPLIED' THEN coalesce(ntp, tp_price) ELSE tp_price END AS tp_after, CASE WHEN a = 'FORCED_EXIT' THEN price END AS exit_price FROM (
    SELECT *, CASE WHEN crossed THEN 'REJECTED' WHEN slp OR tpp THEN 'FORCED_EXIT' ELSE 'APPLIED' END AS a FROM (SELECT *, coalesce((ntp - nsl) * direction <= 0, false) AS crossed, coalesce((price - nsl) * direction <= 0, false) AS slp,
      coalesce((ntp - price) * direction <= 0, false) AS tpp FROM upd))""")
def _(spark, sf):
    i, d = F.col("trade_id"), F.col("direction")
    t = trades(spark, sf).withColumns({"price": F.col("entry_price"), "new_sl": F.col("entry_price") - d * (i % 9 - 2), "new_tp": F.when(i % 4 != 0, F.col("entry_price") + d * (i % 12 - 3))})
    return X.apply_updates(t.drop("exit_price"))


@query("trailing_stop_path", "symbol ts b_ts stop:r", """SELECT symbol, ts, b_ts, CASE WHEN abs(mark - entry_price) >= 10 THEN mark - direction * 15 END AS stop FROM (SELECT e.*, b.ts AS b_ts,
    CASE WHEN direction = 1 THEN greatest(entry_price, max(b.high) OVER w) ELSE least(entry_price, min(b.low) OVER w) END AS mark FROM entries e JOIN bars b ON b.symbol = e.symbol AND b.ts > e.ts AND b.ts <= e.end_ts
    WINDOW w AS (PARTITION BY e.symbol, e.ts ORDER BY b.ts))""")
def _(spark, sf):
    e = cross_entries(spark, sf).withColumns({"trail_points": F.lit(15.0), "trail_activation_points": F.lit(10.0)})
    return X.trailing_stop_path(e, bars(spark, sf))


@query("trailing_exit", "entry_id:s exit_ts exit_price:r")
def _(spark, sf):
    e = cross_entries(spark, sf).withColumns({"trail_points": F.lit(15.0), "trail_activation_points": F.lit(10.0)})
    return X.trailing_exit(X.trailing_stop_path(e, bars(spark, sf)))
