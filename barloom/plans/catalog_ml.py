"""Queries over feature tables, thresholds, votes and models."""
from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import rmetrics as R
from barloom.operators import evalml as E
from barloom.operators import indicators as I
from barloom.operators import mlset as M
from barloom.operators import patterns as P
from barloom.operators import positions as PO
from barloom.operators.audit import lookahead_audit
from barloom.operators.joins import asof_join
from barloom.plans.bindings import bars, r_trades, stored_bars, table, ticks, trades
from barloom.plans.registry import cte, query
from barloom.session import cut

CFG, ORD = ["config_idx"], ["date", "trade_id"]


def month():
    return F.trunc("date", "month")


SORTINO = """CASE WHEN count({x}) = 0 THEN 0 WHEN count(*) FILTER ({x} < 0) = 0 THEN CASE WHEN avg({x}) > 0 THEN 'inf'::DOUBLE ELSE 0 END
    ELSE avg({x}) / sqrt(avg({x} * {x}) FILTER ({x} < 0)) END"""
PF = """CASE WHEN count(*) FILTER ({x} < 0) = 0 THEN CASE WHEN count(*) FILTER ({x} > 0) > 0 THEN 'inf'::DOUBLE ELSE 0 END
    ELSE coalesce(sum({x}) FILTER ({x} > 0), 0) / -sum({x}) FILTER ({x} < 0) END"""


def metrics_sql(x: str, tag: str = "") -> str:
    return f"coalesce(avg(CASE WHEN {x} > 0 THEN 1.0 WHEN {x} <= 0 THEN 0.0 END), 0) AS {tag}win_rate, coalesce(avg({x}), 0) AS {tag}expectancy, {SORTINO.format(x=x)} AS {tag}sortino, {PF.format(x=x)} AS {tag}profit_factor"


MET = "win_rate:r expectancy:r sortino:r profit_factor:r"


def tagged(tag: str) -> str:
    return " ".join(tag + m for m in MET.split())


cte("ctx", """SELECT *, row_number() OVER (PARTITION BY config_idx, date ORDER BY trade_id) - 1 AS daily_trade_idx, coalesce(avg((r > 0)::INT) OVER (PARTITION BY config_idx ORDER BY date, trade_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0.5) AS recent_win_rate_10,
    coalesce(avg(r) OVER (PARTITION BY config_idx ORDER BY date, trade_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) AS recent_expectancy_r_10,
    n - 1 - coalesce(max(CASE WHEN r > 0 THEN n END) OVER p, 0) AS consecutive_losses,
    coalesce(sum(r) OVER (PARTITION BY config_idx, date ORDER BY trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS session_r_so_far,
    coalesce(least(date_diff('day', max(CASE WHEN r > 0 THEN date END) OVER p, date), 30), 30) AS days_since_last_win,
    CASE WHEN n <= 5 THEN 0.5 WHEN count(*) FILTER (r < 0) OVER p = 0 THEN CASE WHEN avg(r) OVER p > 0 THEN 1.0 ELSE 0.5 END
      ELSE greatest(-2, least(2, avg(r) OVER p / sqrt(avg(r * r) FILTER (r < 0) OVER p))) / 4 + 0.5 END AS rolling_metric
    FROM (SELECT *, row_number() OVER (PARTITION BY config_idx ORDER BY date, trade_id) AS n FROM r_trades)
    WINDOW p AS (PARTITION BY config_idx ORDER BY date, trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")


@query("trade_context", "config_idx:i trade_id:i daily_trade_idx:i recent_win_rate_10:r recent_expectancy_r_10:r consecutive_losses:i session_r_so_far:r days_since_last_win:r", "SELECT * FROM ctx")
def _(spark, sf):
    return M.trade_context(r_trades(spark, sf), CFG, ORD, "date", "r", month())


@query("rolling_r_metric", "config_idx:i trade_id:i rolling_metric:r", "SELECT * FROM ctx")
def _(spark, sf):
    return M.trade_context(r_trades(spark, sf), CFG, ORD, "date", "r", month())


def signal_rows(spark, sf):
    pick = lambda c, xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (c % len(xs) + 1).cast("int"))
    i, p = F.col("trade_id"), F.col("entry_price")
    return trades(spark, sf).select(
        "trade_id", pick(i, ("OTE", "STDV", "SESSION_OTE")).alias("fib_type"), "direction", (0.5 + i % 5 / 10.0).alias("fib_value"), pick(i, ("OB", "BB", "FVG", "IFVG", "RB", "PDH", "")).alias("conf_kind"),
        pick(i, ("1m", "5m", "15m", "30m", "")).alias("conf_tf"), (i % 4 / 2.0).alias("leg_size_atr"), (p + 2).alias("zone_top"), (p - 1).alias("zone_bot"), p.alias("entry"), F.col("initial_sl_price").alias("sl"), F.lit(4.0).alias("atr"),
        F.slice(F.array(p + 10, p + 14, p + 21), 1, (i % 4).cast("int")).alias("tp_prices"), (p + 10).alias("chosen_tp"), F.hour("entry_ts").alias("minutes_since_open"), F.weekday("entry_ts").alias("weekday"), (i % 3).alias("n_levels"), (p + 1).alias("close"))


@query("encode_signal_features", "trade_id:i is_ote:i conf_ob:i conf_session:i conf_tf_5m:i zone_range_atr:r sl_risk_atr:r n_tp_candidates:i tp_r:r tp_next_r:r atr_pct:r day_of_week:i",
       """SELECT trade_id, (trade_id % 3 = 0)::INT AS is_ote, (trade_id % 7 = 0)::INT AS conf_ob, (trade_id % 7 = 5)::INT AS conf_session, (trade_id % 5 = 1)::INT AS conf_tf_5m, 0.75::DOUBLE AS zone_range_atr, risk / 4 AS sl_risk_atr, trade_id % 4 AS n_tp_candidates,
       CASE WHEN trade_id % 4 > 0 THEN 10 / risk ELSE -1 END AS tp_r, CASE WHEN trade_id % 4 > 1 THEN 14 / risk ELSE -1 END AS tp_next_r, 4 / greatest(entry_price + 1, 1e-9) * 100 AS atr_pct, isodow(entry_ts) - 1 AS day_of_week FROM (SELECT *, abs(entry_price - initial_sl_price) AS risk FROM trades)""")
def _(spark, sf):
    return signal_rows(spark, sf).select("trade_id", *[c.alias(n) for n, c in M.encode_signal_features().items()])


@query("normalize_config", "p_partkey:i cfg_size:r cfg_price:r cfg_base_metric:r", """SELECT p_partkey, greatest(0, least(1, (p_size - 5) / 35.0::DOUBLE)) AS cfg_size, greatest(0, least(1, (p_retailprice - 950) / 500)) AS cfg_price,
    greatest(-2, least(2, (p_retailprice - 1000) / 200)) / 4 + 0.5 AS cfg_base_metric FROM part""")
def _(spark, sf):
    d = table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"), ((F.col("p_retailprice") - 1000) / 200).alias("m"))
    return M.normalize_config(d, {"size": (5, 40), "price": (950, 1450)}, "m")


def ml_rows(spark, sf):
    i = F.col("trade_id")
    return r_trades(spark, sf).select("trade_id", "config_idx", "r", F.when(i % 2 == 0, 1).otherwise(-1).alias("direction"), (1 + i % 3 / 2.0).alias("sl_risk_atr"), (i % 5 / 2.0).alias("tp_r"), F.lit(2.0).alias("tp_next_r"),
                                      F.lit(3).alias("n_tp_candidates"), F.col("r").alias("r_multiple"), (F.col("r") > 0).cast("int").alias("is_winner"), (5.0 + i % 7).alias("sl_pts"), (F.col("r") * 100).alias("net_pnl_dollars"))


@query("reverse_ml_dataset", "trade_id:i direction:i sl_risk_atr:r tp_r:r r_multiple:r is_winner:i sl_pts:r net_pnl_dollars:r", """SELECT trade_id, CASE WHEN trade_id % 2 = 0 THEN -1 ELSE 1 END AS direction, (1 + trade_id % 3 / 2.0::DOUBLE) * t AS sl_risk_atr, 1 / t AS tp_r,
    -r / t AS r_multiple, (-r / t > 0)::INT AS is_winner, (5 + trade_id % 7) * t AS sl_pts, -(r * 100) AS net_pnl_dollars FROM (SELECT *, CASE WHEN trade_id % 5 = 0 THEN 1e-6 ELSE trade_id % 5 / 2.0::DOUBLE END AS t FROM r_trades)""")
def _(spark, sf):
    return M.reverse_ml_dataset(ml_rows(spark, sf))


@query("union_keep_last", "config_idx:i k:i r:r round:i extra:r", """SELECT config_idx, k, r, round, extra FROM (SELECT *, row_number() OVER (PARTITION BY config_idx, k ORDER BY round DESC, r DESC) AS rn FROM (
    SELECT config_idx, trade_id % 500 AS k, max(r) AS r, 1 AS round, 0.0::DOUBLE AS extra FROM r_trades WHERE trade_id % 3 <> 0 GROUP BY 1, 2
    UNION ALL SELECT config_idx, trade_id % 500 AS k, min(r) AS r, 2 AS round, 1.0::DOUBLE AS extra FROM r_trades WHERE trade_id % 2 = 0 GROUP BY 1, 2)) WHERE rn = 1""")
def _(spark, sf):
    t = r_trades(spark, sf).withColumn("k", F.col("trade_id") % 500)
    old = t.where("trade_id % 3 <> 0").groupBy("config_idx", "k").agg(F.max("r").alias("r")).withColumn("round", F.lit(1))
    new = t.where("trade_id % 2 = 0").groupBy("config_idx", "k").agg(F.min("r").alias("r")).withColumns({"round": F.lit(2), "extra": F.lit(1.0)})
    return M.union_keep_last(old, new, ["config_idx", "k"], "round")


@query("union_train_val", "split:s n:i", "SELECT split, count(*) AS n FROM (SELECT 'train' AS split FROM r_trades WHERE date < DATE '2000-01-01' UNION ALL SELECT 'validation' FROM r_trades WHERE date >= DATE '2000-01-01') GROUP BY 1")
def _(spark, sf):
    t = r_trades(spark, sf)
    day = F.lit("2000-01-01").cast("date")
    u = t.where(F.col("date") < day).withColumn("split", F.lit("train")).unionByName(t.where(F.col("date") >= day).withColumn("split", F.lit("validation")))
    return u.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


BOUNDS = {"train": ("1900-01-01", "1998-12-31"), "validation": ("1999-01-01", "1999-12-31"), "test": ("2000-01-01", "2200-01-01")}
cte("splits", "SELECT *, CASE WHEN date <= DATE '1998-12-31' THEN 'train' WHEN date <= DATE '1999-12-31' THEN 'validation' ELSE 'test' END AS split, 1 + trade_id % 3 AS round FROM r_trades")


def split_rows(spark, sf):
    return r_trades(spark, sf).withColumns({"split": M.split_label(F.col("date"), BOUNDS), "round": (1 + F.col("trade_id") % 3).cast("int")})


@query("split_label", "trade_id:i split:s", "SELECT * FROM splits")
def _(spark, sf):
    return split_rows(spark, sf)


@query("split_filter", "trade_id:i date:d", "SELECT * FROM r_trades WHERE date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31'")
def _(spark, sf):
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in ("1999-01-01", "2000-01-01"))
    o = table(spark, sf, "orders").where((F.col("o_orderdate") >= lo) & (F.col("o_orderdate") < hi))
    return o.select(F.col("o_orderkey").alias("trade_id"), F.to_date("o_orderdate").alias("date"))


@query("dataset_profile", "split:s n:i win_rate:r mean_r:r rounds:s", "SELECT split, count(*) AS n, avg((r > 0)::INT) AS win_rate, avg(r) AS mean_r, string_agg(DISTINCT round::VARCHAR, ',' ORDER BY round::VARCHAR) AS rounds FROM splits GROUP BY 1")
def _(spark, sf):
    return M.dataset_profile(split_rows(spark, sf)).withColumn("rounds", F.concat_ws(",", F.col("rounds").cast("array<string>")))


@query("walk_forward_folds", "fold:i train_start:d train_end:d test_start:d test_end:d", """WITH s AS (SELECT min(date) AS s, max(date) AS e FROM r_trades), f AS (SELECT k AS fold, s, e, CAST(s + INTERVAL 27 MONTH AS DATE) + to_months(CAST(k AS INT) * 6) AS ts FROM s, range(0, 40) r(k)),
    g AS (SELECT fold, s, e, CAST(ts AS DATE) AS test_start, CAST(ts + INTERVAL 6 MONTH - INTERVAL 1 DAY AS DATE) AS test_end, CAST(ts - INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS train_end FROM f)
    SELECT *, greatest(s, CAST(CAST(train_end - INTERVAL 24 MONTH AS DATE) + 1 AS DATE)) AS train_start FROM g WHERE test_end <= e""")
def _(spark, sf):
    return M.walk_forward_folds(r_trades(spark, sf), "date", 24, 6, 3)


@query("config_weights", "trade_id:i weight:r", "SELECT trade_id, (SELECT count(*) FROM r_trades) / (SELECT count(DISTINCT config_idx) FROM r_trades)::DOUBLE / count(*) OVER (PARTITION BY config_idx) AS weight FROM r_trades")
def _(spark, sf):
    return M.config_weights(r_trades(spark, sf), "config_idx")


@query("asof_signal_features", "trade_id:i c_ts close:r", """SELECT t.trade_id, b.ts AS c_ts, b.close FROM trades t ASOF LEFT JOIN bars b ON b.symbol = t.symbol AND t.entry_ts >= b.ts + INTERVAL 30 MINUTE""")
def _(spark, sf):
    b = bars(spark, sf).select("symbol", F.col("ts").alias("c_ts"), "close")
    return asof_join(trades(spark, sf).select("trade_id", "symbol", "entry_ts"), b, ["symbol"], "entry_ts", F.col("c_ts") + F.expr("INTERVAL 30 MINUTES"), ["c_ts", "close"])


@query("lookahead_audit", "n:i late:i missing:i", "SELECT count(*) AS n, 0 AS late, (SELECT count(*) FROM trades t WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.symbol = t.symbol AND b.ts + INTERVAL 30 MINUTE <= t.entry_ts)) AS missing FROM trades")
def _(spark, sf):
    b = bars(spark, sf).select("symbol", F.col("ts").alias("c_ts"), "close")
    d = asof_join(trades(spark, sf).select("trade_id", "symbol", "entry_ts"), b, ["symbol"], "entry_ts", F.col("c_ts") + F.expr("INTERVAL 30 MINUTES"), ["c_ts"])
    seen = F.col("c_ts") + F.expr("INTERVAL 30 MINUTES")
    return d.agg(F.count(F.lit(1)).alias("n"), F.sum((seen > F.col("entry_ts")).cast("int")).alias("late"), F.sum(F.col("c_ts").isNull().cast("int")).alias("missing"))


AUDITED = {
    "sma_cross": lambda b: I.sma_cross(b, 5, 20), "bollinger": I.bollinger, "awesome_oscillator": I.awesome_oscillator, "donchian": lambda b: I.donchian(b, 20),
    "rsi": I.rsi, "ema": lambda b: I.ema(b, 10), "heikin_ashi": I.heikin_ashi, "atr": I.atr, "candle_shape": P.candle_shape,
}
_UNTIL = "(SELECT time_bucket(INTERVAL 30 MINUTE, min(ts) + (max(ts) - min(ts)) / 2) FROM events)"


@query("lookahead_audit_features", "feature:s n:i changed:i", "SELECT f AS feature, count(*) AS n, 0 AS changed FROM bars, (VALUES " + ", ".join(f"('{f}')" for f in AUDITED) + f") v(f) WHERE ts <= {_UNTIL} GROUP BY 1")
def _(spark, sf):
    """Every indicator on all bars and on the first half of them: no row of the first half may change."""
    lo, hi = ticks(spark, sf).agg(F.min("ts"), F.max("ts")).first()
    mid = lo + (hi - lo) / 2
    return lookahead_audit(stored_bars(spark, sf), AUDITED, mid.replace(minute=mid.minute // 30 * 30, second=0, microsecond=0))


# --- evaluation --------------------------------------------------------------------------------------

@query("r_metrics", "config_idx:i " + MET, f"SELECT config_idx, {metrics_sql('r')} FROM r_trades GROUP BY 1")
def _(spark, sf):
    return r_trades(spark, sf).groupBy("config_idx").agg(*R.all_metrics(F.col("r")))


@query("per_config_metrics", "config_idx:i n_all:i n_taken:i take_rate:r " + MET, f"SELECT config_idx, count(*) AS n_all, count(t) AS n_taken, count(t) / count(*) AS take_rate, {metrics_sql('t')} FROM (SELECT *, CASE WHEN pred >= 0.1 THEN r END AS t FROM r_trades) GROUP BY 1")
def _(spark, sf):
    return E.per_config_metrics(r_trades(spark, sf), 0.1)


@query("evaluate_filter", "status:s n_all:i n_taken:i take_rate:r " + tagged("taken_") + " " + tagged("all_"),
       f"SELECT status, count(*) AS n_all, count(t) AS n_taken, count(t) / count(*) AS take_rate, {metrics_sql('t', 'taken_')}, {metrics_sql('r', 'all_')} FROM (SELECT *, CASE WHEN pred >= 0.1 THEN r END AS t FROM r_trades) GROUP BY 1")
def _(spark, sf):
    return E.evaluate_filter(r_trades(spark, sf), ["status"], F.col("pred") >= 0.1)


cte("sc", "SELECT config_idx, r, r * 0.3::DOUBLE + pred AS p FROM r_trades")
cte("cuts", """SELECT config_idx, k AS step, CASE WHEN k = 49 THEN hi ELSE lo + k * ((hi - lo) / 49) END AS t FROM (SELECT config_idx, quantile_cont(p, 0.05) AS lo, quantile_cont(p, 0.95) AS hi FROM sc GROUP BY 1), range(0, 50) r(k)""")
cte("thr", f"""SELECT c.config_idx, c.step, c.t AS threshold, (SELECT count(*) FROM sc a WHERE a.config_idx = c.config_idx) AS n_all, count(*) AS n_taken, {metrics_sql('s.r')} FROM cuts c JOIN sc s ON s.config_idx = c.config_idx AND s.p >= c.t GROUP BY 1, 2, 3""")


def scored(spark, sf):
    return r_trades(spark, sf).withColumn("pred", F.col("r") * 0.3 + F.col("pred"))


@query("threshold_table", "config_idx:i step:i threshold:r n_all:i n_taken:i " + MET, "SELECT * FROM thr")
def _(spark, sf):
    return E.threshold_table(scored(spark, sf), CFG)


@query("search_threshold", "config_idx:i threshold:r n_taken:i sortino:r", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY config_idx ORDER BY sortino DESC, step) AS rn FROM thr WHERE n_taken >= greatest(1, floor(n_all * 0.15::DOUBLE))) WHERE rn = 1""")
def _(spark, sf):
    return E.search_threshold(scored(spark, sf), CFG)


_vote = {"majority": "avg(v::INT) > 0.5", "unanimous": "min(v::INT) = 1", "weighted": "sum(CASE WHEN v THEN w ELSE 0 END) / sum(w) > 0.5"}
for _m, _c in _vote.items():
    def _make(m):
        def run(spark, sf):
            t = r_trades(spark, sf)
            w = t.select("config_idx").distinct().withColumn("weight", 1.0 + F.col("config_idx") % 4) if m == "weighted" else None
            return E.ensemble_vote(t, 0.0, m, ["date"], w)
        return run
    query(f"ensemble_vote_{_m}", "date:d r:r votes:i", f"SELECT date, avg(r) FILTER (v) AS r, count(*) AS votes FROM (SELECT *, pred >= 0 AS v, 1.0::DOUBLE + config_idx % 4 AS w FROM r_trades) GROUP BY 1 HAVING {_c}")(_make(_m))


@query("ensemble_summary", "n_signals:i n_taken:i take_rate:r " + MET, f"SELECT (SELECT count(DISTINCT date) FROM r_trades) AS n_signals, count(*) AS n_taken, count(*) / (SELECT count(DISTINCT date) FROM r_trades) AS take_rate, {metrics_sql('r')} FROM (SELECT date, avg(r) FILTER (pred >= 0) AS r FROM r_trades GROUP BY 1 HAVING avg((pred >= 0)::INT) > 0.5)")
def _(spark, sf):
    t = r_trades(spark, sf)
    return E.ensemble_summary(t, E.ensemble_vote(t, 0.0, "majority", ["date"]), ["date"])


@query("config_selection", "config_idx:i val_metric:r n_taken:i taken_sortino:r verdict:s", f"""WITH v AS (SELECT config_idx, {metrics_sql('t')} FROM (SELECT *, CASE WHEN pred >= 0.1 THEN r END AS t FROM r_trades WHERE date < DATE '1998-01-01') GROUP BY 1 HAVING count(t) > 0 ORDER BY sortino DESC, config_idx LIMIT 5),
    t AS (SELECT config_idx, count(t) AS n_taken, {metrics_sql('t', 'taken_')}, {metrics_sql('r', 'all_')} FROM (SELECT *, CASE WHEN pred >= 0.1 THEN r END AS t FROM r_trades WHERE date >= DATE '1998-01-01') GROUP BY 1)
    SELECT v.config_idx, v.sortino AS val_metric, n_taken, taken_sortino, CASE WHEN n_taken = 0 OR taken_sortino <= 0 THEN 'FAIL' WHEN taken_sortino > all_sortino THEN 'PASS' ELSE 'MARGINAL' END AS verdict FROM v LEFT JOIN t USING (config_idx)""")
def _(spark, sf):
    t, day = r_trades(spark, sf), F.lit("1998-01-01").cast("date")
    return E.config_selection(t.where(F.col("date") < day), t.where(F.col("date") >= day), 0.1, 5)


def positions(spark, sf):
    """Scored positions: start = event time, end = the same user's next event, one book per symbol."""
    return trades(spark, sf).select("symbol", "trade_id", "entry_ts", "exit_ts", (F.col("trade_id") * 37 % 101 / 100.0).alias("pred"),
                                    ((F.col("exit_price") - F.col("entry_price")) * F.col("direction")).alias("r"))


@query("greedy_non_overlap", "symbol trade_id:i entry_ts exit_ts", """WITH RECURSIVE p AS (SELECT symbol, trade_id, entry_ts, exit_ts FROM trades), g AS (SELECT symbol, arg_min(trade_id, entry_ts) AS trade_id, min(entry_ts) AS entry_ts, arg_min(exit_ts, entry_ts) AS exit_ts FROM p GROUP BY 1
    UNION ALL SELECT n.symbol, n.trade_id, n.entry_ts, n.exit_ts FROM (SELECT p.*, row_number() OVER (PARTITION BY p.symbol ORDER BY p.entry_ts) AS rn FROM g JOIN p ON p.symbol = g.symbol AND p.entry_ts > g.exit_ts) n WHERE rn = 1) SELECT * FROM g""")
def _(spark, sf):
    return PO.greedy_non_overlap(positions(spark, sf), ["symbol"], "entry_ts", "exit_ts", "pred", "trade_id")


# Each threshold's chain, step by step: from an exit to the first later start whose best score is above the threshold.
_CHAIN = "SELECT {0}, o.entry_ts, o.exit_ts, o.r, o.high FROM {1} JOIN one o ON o.symbol = {2}.symbol AND o.entry_ts = (SELECT min(x.entry_ts) FROM one x WHERE x.symbol = {2}.symbol AND x.pred > {2}.threshold{3})"


@query("threshold_sweep_selection", "symbol threshold:r n:i total_r:r win_rate:r usable:b tpd:r n_high:i", f"""WITH RECURSIVE p AS (SELECT symbol, trade_id, entry_ts, exit_ts, trade_id * 37 % 101 / 100.0::DOUBLE AS pred, (exit_price - entry_price) * direction AS r, (trade_id * 53 % 97 / 97.0::DOUBLE > 0.5)::INT AS high FROM trades),
    one AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY symbol, entry_ts ORDER BY pred DESC, trade_id) = 1),
    t AS (SELECT DISTINCT symbol, k / 40.0::DOUBLE AS threshold FROM p, range(0, 40) q(k)),
    g AS ({_CHAIN.format("t.symbol, t.threshold", "t", "t", "")} UNION ALL {_CHAIN.format("g.symbol, g.threshold", "g", "g", " AND x.entry_ts > g.exit_ts")})
    SELECT g.symbol, threshold, count(*) AS n, sum(r) AS total_r, avg((r > 0)::INT) AS win_rate, count(*) >= 5 AS usable, CASE WHEN count(*) >= 5 THEN greatest(0.1::DOUBLE, count(*) / any_value(days)) ELSE 0 END AS tpd, sum(high) AS n_high
    FROM g JOIN (SELECT symbol, count(DISTINCT CAST(entry_ts AS DATE)) AS days FROM p GROUP BY 1) d USING (symbol) GROUP BY 1, 2""")
def _(spark, sf):
    d = positions(spark, sf).withColumn("p_high", F.col("trade_id") * 53 % 97 / 97.0)
    return PO.threshold_sweep_selection(d, ["symbol"], [k / 40.0 for k in range(40)], "entry_ts", "exit_ts", "trade_id", p_high="p_high")


# --- models ------------------------------------------------------------------------------------------

FEATURES = ["price", "prio", "balance", "weekday", "month"]


def model_rows(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    d = o.join(c.select(F.col("c_custkey").alias("o_custkey"), "c_acctbal"), "o_custkey", "left")
    return d.select(
        F.col("o_orderkey").alias("trade_id"), (F.col("o_custkey") % 20).alias("config_idx"), F.to_date("o_orderdate").alias("date"), (F.col("o_totalprice") / 1000.0).alias("price"),
        F.substring("o_orderpriority", 1, 1).cast("double").alias("prio"), F.coalesce("c_acctbal", F.lit(0.0)).alias("balance"), F.weekday("o_orderdate").cast("double").alias("weekday"),
        F.month("o_orderdate").cast("double").alias("month"), ((F.col("o_totalprice") - 250000.0) / 100000.0 + (F.col("o_orderkey") % 7) / 10.0).alias("r")).withColumn("win", (F.col("r") > 0).cast("int"))


_fitted: dict[tuple, object] = {}


def regressor(spark, sf, weighted=False):
    """The operator's own 300 trees of depth 4; one fit serves all queries of a session that score with it."""
    key = (spark.sparkContext.applicationId, sf, weighted)
    if key not in _fitted:
        d = cut(M.config_weights(model_rows(spark, sf), "config_idx") if weighted else model_rows(spark, sf))
        _fitted[key] = E.fit_regressor(d, FEATURES, weight="weight" if weighted else None)
    return _fitted[key]


@query("fit_regressor_predict", "trade_id:i r:r pred:r")
def _(spark, sf):
    return regressor(spark, sf, weighted=True).transform(M.config_weights(model_rows(spark, sf), "config_idx"))


@query("fit_win_probability", "trade_id:i p_win:r")
def _(spark, sf):
    d = model_rows(spark, sf)
    model, calibration = E.fit_win_probability(d, FEATURES, "win", folds=3)
    return E.win_probability(model, calibration, d)


@query("ensemble_score", "trade_id:i pred:r p_win:r score:r")
def _(spark, sf):
    d = model_rows(spark, sf)
    model, calibration = E.fit_win_probability(d, FEATURES, "win", folds=3)
    reg = regressor(spark, sf)
    both = E.win_probability(model, calibration, reg.transform(d))
    return both.withColumn("score", F.col("pred") * F.col("p_win"))


@query("best_execution_candidate", "trade_id:i cand:i pred:r price:r")
def _(spark, sf):
    d = model_rows(spark, sf)
    return E.best_execution(d, regressor(spark, sf), [{"price": 100.0}, {"price": 200.0}, {"price": 300.0}], "trade_id")


@query("target_index", "trade_id:i idx:i", "SELECT trade_id, CASE WHEN trade_id % 4 > 1 AND r_multiple > 0 AND r_multiple >= (10 + 14) / 2 / abs(entry_price - initial_sl_price) THEN 1 ELSE 0 END AS idx FROM pnl")
def _(spark, sf):
    risk = F.abs(F.col("entry_price") - F.col("initial_sl_price"))
    r = (F.col("exit_price") - F.col("entry_price")) * F.col("direction") / risk
    return trades(spark, sf).select("trade_id", E.target_index(r, F.lit(10.0), F.lit(14.0), F.col("trade_id") % 4, risk).alias("idx"))


@query("top_features", "feature:s importance:r")
def _(spark, sf):
    return E.top_features(E.feature_importance(regressor(spark, sf), FEATURES, spark))


@query("feature_share", "kind:s importance:r share:r")
def _(spark, sf):
    names = [f if f != "month" else "cfg_month" for f in FEATURES]
    return E.feature_share(E.feature_importance(regressor(spark, sf), names, spark))


@query("walk_forward_fit", "fold:i status:s n_train:i n_test:i threshold:r n_all:i n_taken:i taken_sortino:r all_sortino:r")
def _(spark, sf):
    d = model_rows(spark, sf)
    folds = [f.asDict() for f in M.walk_forward_folds(d, "date", 36, 12, 1).orderBy("fold").collect()]  # a few rows
    return E.walk_forward_fit(d, folds, FEATURES, "date").report


