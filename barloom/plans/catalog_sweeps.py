"""Queries over parameter grids, outcome tables and trade sequences."""
from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.scalar import params_hash
from barloom.operators import bars as B
from barloom.operators import ledger as L
from barloom.operators import resample as RS
from barloom.operators import sets as U
from barloom.operators import sweeps as W
from barloom.operators.joins import grid, missing_combos, only_configs
from barloom.plans.bindings import bars, outcomes, r_trades, table, trades
from barloom.plans.registry import cte, query

NDAYS_SQL = "(SELECT count(DISTINCT date) FROM r_trades)"


def n_days(t):
    return t.select("date").distinct().agg(F.count(F.lit(1))).scalar()


SORTINO_C = "CASE WHEN count(*) < 5 THEN '-inf'::DOUBLE WHEN count(*) FILTER (dr < 0) = 0 OR stddev_pop(dr) FILTER (dr < 0) <= 0 THEN 'inf'::DOUBLE ELSE avg(dr) / stddev_pop(dr) FILTER (dr < 0) END"


@query("config_screen", "config_idx:i n:i tpd:r win_rate:r avg_r:r sortino:r", f"""SELECT config_idx, sum(n) AS n, sum(n) / {NDAYS_SQL} AS tpd, sum(w) / sum(n) AS win_rate, sum(dr) / sum(n) AS avg_r, {SORTINO_C} AS sortino
    FROM (SELECT config_idx, date, sum(r) AS dr, count(*) AS n, count(*) FILTER (r > 0) AS w FROM r_trades GROUP BY 1, 2) GROUP BY 1 HAVING sum(n) >= 50""")
def _(spark, sf):
    t = r_trades(spark, sf)
    return W.config_screen(t, ["config_idx"], n_days(t), min_n=50)


SKIPS, BEYONDS = [0, 15, 30, 60, 120], [float("-inf"), 0.1, 0.25, 0.5, 0.75]


def cached_trades(spark, sf):
    return r_trades(spark, sf).withColumns({"elapsed": F.col("minute"), "beyond": F.when(F.col("pred") > 0.4, F.lit(float("inf"))).otherwise(F.col("pred") + 0.5)})


cte("fsweep", f"""SELECT config_idx, skip, beyond, sum(n) AS n, sum(n) / {NDAYS_SQL} AS tpd, sum(w) / sum(n) AS win_rate, sum(dr) / sum(n) AS avg_r, {SORTINO_C} AS sortino FROM (
    SELECT config_idx, skip, b AS beyond, date, sum(r) AS dr, count(*) AS n, count(*) FILTER (r > 0) AS w FROM (SELECT *, CASE WHEN pred > 0.4 THEN 'inf'::DOUBLE ELSE pred + 0.5 END AS bey FROM r_trades) t
    JOIN (VALUES (0.0::DOUBLE), (15), (30), (60), (120)) s(skip) ON t.minute >= skip JOIN (VALUES ('-inf'::DOUBLE), (0.1), (0.25), (0.5), (0.75)) v(b) ON t.bey >= b GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3 HAVING sum(n) >= 20""")


@query("filter_sweep", "config_idx:i skip:r beyond:r n:i tpd:r win_rate:r avg_r:r sortino:r", "SELECT * FROM fsweep")
def _(spark, sf):
    t = cached_trades(spark, sf)
    return W.filter_sweep(t, ["config_idx"], SKIPS, BEYONDS, n_days(t), min_n=20)


@query("top_n_configs", "config_idx:i skip:r beyond:r sortino:r", "SELECT * FROM fsweep ORDER BY sortino DESC, config_idx, skip, beyond LIMIT 30")
def _(spark, sf):
    t = cached_trades(spark, sf)
    return W.top_n(W.filter_sweep(t, ["config_idx"], SKIPS, BEYONDS, n_days(t), min_n=20), 30, F.desc("sortino"), F.col("config_idx"), F.col("skip"), F.col("beyond"))


@query("grid_cross", "p_partkey:i fast:i slow:i stop:r combo:s", """SELECT p_partkey, fast, slow, stop, p_partkey || '-' || fast || '-' || slow AS combo FROM part, (VALUES (5), (10), (20)) a(fast), (VALUES (50), (100)) b(slow), (VALUES (0.5::DOUBLE), (1.0)) c(stop)""")
def _(spark, sf):
    d = grid(table(spark, sf, "part").select("p_partkey"), fast=[5, 10, 20], slow=[50, 100], stop=[0.5, 1.0])
    return d.withColumn("combo", F.concat_ws("-", "p_partkey", "fast", "slow"))


@query("resume_anti", "config_idx:i skip:i", "SELECT c.config_idx, s.skip FROM (SELECT DISTINCT config_idx FROM r_trades) c, (VALUES (0), (15), (30)) s(skip) WHERE NOT EXISTS (SELECT 1 FROM r_trades t WHERE t.config_idx = c.config_idx AND t.minute = s.skip AND t.r > 0)")
def _(spark, sf):
    t = r_trades(spark, sf)
    wanted = grid(t.select("config_idx").distinct(), skip=[0, 15, 30])
    return missing_combos(wanted, t.where("r > 0").select("config_idx", F.col("minute").alias("skip")), ["config_idx", "skip"])


@query("config_semi", "config_idx:i trade_id:i", "SELECT config_idx, trade_id FROM r_trades WHERE config_idx IN (SELECT config_idx FROM r_trades GROUP BY 1 HAVING avg(r) > 0.05)")
def _(spark, sf):
    t = r_trades(spark, sf)
    return only_configs(t, t.groupBy("config_idx").agg(F.avg("r").alias("m")).where("m > 0.05"), ["config_idx"])


@query("except_configs", "h:s", "SELECT DISTINCT substr(md5('{\"brand\":\"' || p_brand || '\"}'), 1, 12) AS h FROM part WHERE p_size < 10 AND p_brand NOT IN (SELECT p_brand FROM part WHERE p_size >= 45)")
def _(spark, sf):
    p = table(spark, sf, "part").withColumn("h", params_hash(F.create_map(F.lit("brand"), F.col("p_brand")), "md5"))
    return U.except_configs(p.where("p_size < 10").select("h"), p.where("p_size >= 45").select("h"), ["h"])


@query("is_oos_compare", "config_idx:i is_n:i is_avg_r:r oos_n:i oos_avg_r:r", """WITH a AS (SELECT config_idx, count(*) AS n, avg(r) AS m FROM r_trades WHERE date < DATE '1999-01-01' GROUP BY 1), b AS (SELECT config_idx, count(*) AS n, avg(r) AS m FROM r_trades WHERE date >= DATE '1999-01-01' GROUP BY 1)
    SELECT a.config_idx, a.n AS is_n, a.m AS is_avg_r, b.n AS oos_n, b.m AS oos_avg_r FROM a LEFT JOIN b USING (config_idx)""")
def _(spark, sf):
    t, day = r_trades(spark, sf), F.lit("1999-01-01").cast("date")
    m = lambda d: d.groupBy("config_idx").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("avg_r"))
    return W.is_oos_compare(m(t.where(F.col("date") < day)), m(t.where(F.col("date") >= day)), ["config_idx"], ["n", "avg_r"])


@query("perturb_params", "p_partkey:i key:s value:r", " UNION ALL ".join(f"SELECT p_partkey, '{k}{s}' AS key, {c} * {m}::DOUBLE AS value FROM part WHERE {c} <> 0" for k, c in (("size", "p_size"), ("price", "p_retailprice")) for s, m in (("+", 1.1), ("-", 0.9))))
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    return W.perturb_params(p, ["size", "price"], 0.1, "p_partkey")


@query("aggregate_sensitivity", "config_idx:i base_metric:r worst_metric:r worst_param:s degradation_pct:r is_stable:b is_valid:b", """WITH b AS (SELECT config_idx, avg(r) AS base_metric FROM r_trades GROUP BY 1), p AS (SELECT config_idx, k || s AS key, avg(r) AS metric FROM (SELECT config_idx, r, 'p' || trade_id % 5 AS k, CASE WHEN trade_id % 2 = 0 THEN '+' ELSE '-' END AS s FROM r_trades) GROUP BY 1, 2),
    w AS (SELECT config_idx, min(metric) AS m, arg_min(key, metric) AS k FROM p GROUP BY 1), j AS (SELECT b.config_idx, base_metric, CASE WHEN m < base_metric THEN m ELSE base_metric END AS worst_metric, CASE WHEN m < base_metric THEN rtrim(k, '+-') ELSE '' END AS worst_param FROM b LEFT JOIN w USING (config_idx))
    SELECT *, degradation_pct <= 200 AS is_stable, degradation_pct <= 200 AND base_metric >= 0 AS is_valid FROM (SELECT *, CASE WHEN abs(base_metric) < 1e-9 THEN 0 ELSE (base_metric - worst_metric) / abs(base_metric) * 100 END AS degradation_pct FROM j)""")
def _(spark, sf):
    t = r_trades(spark, sf)
    key = F.concat(F.lit("p"), F.col("trade_id") % 5, F.when(F.col("trade_id") % 2 == 0, "+").otherwise("-"))
    runs = t.groupBy("config_idx", key.alias("key")).agg(F.avg("r").alias("metric"))
    return W.aggregate_sensitivity(t.groupBy("config_idx").agg(F.avg("r").alias("base_metric")), runs, "config_idx", 200.0, 0.0)


H = "('0x' || substr(md5({}), 1, 12))::BIGINT"


@query("sample_configs", "p_partkey:i size:i price:r kind:s", f"""WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY {H.format("'42:size:' || p_partkey")}, p_partkey) AS s1, row_number() OVER (ORDER BY {H.format("'42:price:' || p_partkey")}, p_partkey) AS s2, (SELECT count(*) FROM part) AS n FROM part)
    SELECT p_partkey, greatest(5, least(40, round_even(5 + (s1 - 1 + {H.format("'42:size:u:' || p_partkey")} / 281474976710656.0::DOUBLE) / n * 35, 0))) AS size, 100.0::DOUBLE + (s2 - 1 + {H.format("'42:price:u:' || p_partkey")} / 281474976710656.0::DOUBLE) / n * 900 AS price,
    CASE {H.format("'42:kind:' || p_partkey")} % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS kind FROM r""")
def _(spark, sf):
    return W.sample_configs(table(spark, sf, "part"), "p_partkey", {"size": (5, 40), "price": (100.0, 1000.0)}, ["size"], {"kind": ["a", "b", "c"]})


@query("config_manifest", "p_partkey:i line:s h:s", """SELECT p_partkey, '{"idx":' || p_partkey || ',"params":{"brand":"' || p_brand || '","size":"' || p_size || '"}}' AS line, substr(md5('{"brand":"' || p_brand || '","size":"' || p_size || '"}'), 1, 12) AS h FROM part""")
def _(spark, sf):
    from barloom.sources.datasets import manifest_rows
    p = table(spark, sf, "part").select("p_partkey", F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string")).alias("params"))
    return manifest_rows(p, "p_partkey", "params", "md5")


# --- outcome grids -----------------------------------------------------------------------------------

FEES = "CASE account WHEN '25K' THEN 70 ELSE 98 END + CASE WHEN pass_rate > 0 THEN greatest(0, 1 / pass_rate - 1) ELSE 10 END * CASE account WHEN '25K' THEN 60 ELSE 105 END"
cte("osum", f"""SELECT *, net_ev / greatest(1, eval_total_days + mean_funded_days) AS ev_per_day FROM (SELECT *, pass_rate * mean_withdrawal - eval_cost AS net_ev,
    greatest(0, CASE WHEN pass_rate > 0 THEN 1 / pass_rate ELSE 10 END - 1) * coalesce(df, days_pass) + days_pass AS eval_total_days FROM (SELECT *, {FEES} AS eval_cost FROM (
    SELECT account, scheme, erp, frp, count(*) AS n_paths, avg(passed::INT) AS pass_rate, coalesce(quantile_cont(eval_days, 0.5) FILTER (passed), 0) AS days_pass, quantile_cont(eval_days, 0.5) FILTER (NOT passed) AS df,
    avg((withdrawn > 0)::INT) AS survival, coalesce(quantile_cont(withdrawn, 0.5) FILTER (withdrawn > 0), 0) AS median_withdrawal, avg(withdrawn) AS mean_withdrawal, quantile_cont(n_payouts, 0.5) AS median_payouts,
    avg((n_payouts >= 4)::INT) AS full_payout, avg(funded_days) AS mean_funded_days FROM outcomes GROUP BY 1, 2, 3, 4)))""")
KEY = "account:s scheme:s erp:r frp:r "


def summary(spark, sf):
    return W.outcome_summary(outcomes(spark, sf), max_payouts=4)


@query("outcome_summary", KEY + "n_paths:i pass_rate:r days_pass:r survival:r median_withdrawal:r mean_withdrawal:r median_payouts:r full_payout:r eval_cost:r eval_total_days:r net_ev:r ev_per_day:r", "SELECT * FROM osum")
def _(spark, sf):
    return summary(spark, sf)


cte("perk", """SELECT *, CASE WHEN mean_days > 0 THEN ev / (eval_total_days + mean_days) END AS ev_per_day FROM (SELECT g.*, s.eval_total_days, s.pass_rate * mean_first_k - s.eval_cost AS ev FROM (
    SELECT account, scheme, erp, frp, k, avg((n_payouts >= k)::INT) AS p_reach, avg((SELECT coalesce(sum(i * 50 + path % 900 + 500), 0) FROM range(1, 5) r(i) WHERE i <= least(k, n_payouts))) AS mean_first_k,
      avg(CASE WHEN n_payouts >= k THEN k * 8 + path % 6 ELSE funded_days END) AS mean_days FROM outcomes, (VALUES (1), (2), (3), (4)) v(k) GROUP BY 1, 2, 3, 4, 5) g JOIN osum s USING (account, scheme, erp, frp))""")


@query("per_k_payouts", KEY + "k:i p_reach:r mean_first_k:r mean_days:r ev:r ev_per_day:r", "SELECT * FROM perk")
def _(spark, sf):
    return W.per_k_payouts(outcomes(spark, sf), summary(spark, sf), 4)


@query("best_k", KEY + "k:i ev_per_day:r", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account, scheme, erp, frp ORDER BY ev_per_day DESC, k) AS rn FROM perk) WHERE rn = 1")
def _(spark, sf):
    return W.best_k(W.per_k_payouts(outcomes(spark, sf), summary(spark, sf), 4))


@query("payout_gaps", KEY + "payout:i median_day:r median_gap:r n:i", """SELECT account, scheme, erp, frp, i AS payout, quantile_cont(i * 8 + path % 6, 0.5) AS median_day, quantile_cont(CASE WHEN i = 1 THEN 8 + path % 6 ELSE 8 END, 0.5) AS median_gap, count(*) AS n
    FROM outcomes JOIN range(1, 5) r(i) ON i <= n_payouts GROUP BY 1, 2, 3, 4, 5""")
def _(spark, sf):
    return W.payout_gaps(outcomes(spark, sf))


@query("best_cell", KEY + "ev_per_day:r", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY ev_per_day DESC, scheme DESC, erp DESC, frp DESC) AS rn FROM osum) WHERE rn = 1")
def _(spark, sf):
    return W.best_cell(summary(spark, sf))


@query("stability_score", KEY + "stability:r", """SELECT *, greatest(0, 1 - greatest(coalesce(abs(net_ev - lag(net_ev) OVER w), 0), coalesce(abs(net_ev - lead(net_ev) OVER w), 0)) / (greatest(max(net_ev) OVER p - min(net_ev) OVER p, 1) * 0.2::DOUBLE)) AS stability
    FROM osum WINDOW w AS (PARTITION BY account, scheme, frp ORDER BY erp), p AS (PARTITION BY account, scheme, frp)""")
def _(spark, sf):
    return W.stability_score(summary(spark, sf))


@query("grid_pivot", "account:s scheme:s erp:r frp_0_1:r frp_0_2:r frp_0_3:r frp_0_4:r best_frp:r", """SELECT account, scheme, erp, max(ev_per_day) FILTER (frp = 0.1) AS frp_0_1, max(ev_per_day) FILTER (frp = 0.2) AS frp_0_2, max(ev_per_day) FILTER (frp = 0.3) AS frp_0_3, max(ev_per_day) FILTER (frp = 0.4) AS frp_0_4, arg_max(frp, ev_per_day) AS best_frp FROM osum GROUP BY 1, 2, 3""")
def _(spark, sf):
    return W.grid_pivot(summary(spark, sf), "ev_per_day", [0.1, 0.2, 0.3, 0.4])


@query("grid_flatten", KEY + "value:r", "SELECT *, net_ev AS value FROM osum")
def _(spark, sf):
    return W.grid_flatten(W.grid_nest(summary(spark, sf), "net_ev"))


@query("eval_funded_combine", KEY + "pass_rate:r mean_withdrawal:r net_ev:r ev_per_day:r", f"""SELECT *, net_ev / greatest(1, eval_days + funded_days) AS ev_per_day FROM (SELECT *, pass_rate * mean_withdrawal - ({FEES}) AS net_ev FROM
    (SELECT account, scheme, erp, avg(passed::INT) AS pass_rate, avg(eval_days) AS eval_days FROM outcomes GROUP BY 1, 2, 3) JOIN (SELECT account, scheme, frp, avg(withdrawn) AS mean_withdrawal, avg(funded_days) AS funded_days FROM outcomes GROUP BY 1, 2, 3) USING (account, scheme))""")
def _(spark, sf):
    return W.eval_funded_combine(outcomes(spark, sf))


cte("cash", """SELECT account, avg((c <= 0)::INT) AS p_zero, avg((c > 10000)::INT) AS p_profit, avg((c >= 100000)::INT) AS p_goal, avg(c) AS mean, quantile_cont(c, 0.1) AS p10, quantile_cont(c, 0.5) AS p50, quantile_cont(c, 0.9) AS p90
    FROM (SELECT account, withdrawn - 20000 AS c FROM outcomes) GROUP BY 1""")


@query("final_cash_stats", "account:s p_zero:r p_profit:r p_goal:r mean:r p10:r p50:r p90:r", "SELECT * FROM cash")
def _(spark, sf):
    return W.final_cash_stats(outcomes(spark, sf).withColumn("cash", F.col("withdrawn") - 20000), ["account"], "cash", 10000.0, 100000.0)


@query("lexicographic_rank", "pos:i scheme:s erp:r p_zero:r p_goal:r", """SELECT row_number() OVER (ORDER BY p_zero, p_goal DESC, scheme, erp) AS pos, * FROM (SELECT scheme, erp, avg((withdrawn <= 0)::INT) AS p_zero, avg((withdrawn >= 200000)::INT) AS p_goal FROM outcomes GROUP BY 1, 2)""")
def _(spark, sf):
    w = F.col("withdrawn")
    g = outcomes(spark, sf).groupBy("scheme", "erp").agg(F.avg((w <= 0).cast("double")).alias("p_zero"), F.avg((w >= 200000).cast("double")).alias("p_goal"))
    return U.ranked(g, [F.col("p_zero"), F.desc("p_goal"), F.col("scheme"), F.col("erp")])


@query("sweep_report", "scheme:s total:i valid:i positive_ev:i best_ev:r best_combo:s", """SELECT scheme, count(*) AS total, count(ev) AS valid, count(*) FILTER (ev > 0) AS positive_ev, max(ev) AS best_ev, arg_max(combo_id, ev) AS best_combo FROM (
    SELECT scheme, account || '|' || erp || '|' || frp AS combo_id, CASE WHEN n_paths >= 100 THEN net_ev - 45000 END AS ev FROM osum) GROUP BY 1""")
def _(spark, sf):
    s = summary(spark, sf).select("scheme", F.concat_ws("|", "account", "erp", "frp").alias("combo_id"), F.when(F.col("n_paths") >= 100, F.col("net_ev") - 45000).alias("ev"))
    return W.sweep_report(s, "scheme")


@query("sl_coverage", "run_id:i coverage:r", "SELECT run_id, avg((sl_price IS NOT NULL)::INT) AS coverage FROM trades GROUP BY 1")
def _(spark, sf):
    return U.sl_coverage(trades(spark, sf), ["run_id"])


@query("filter_meta", "trade_id:i session:s elapsed:i beyond:r", """WITH f AS (SELECT symbol, CAST(ts AS DATE) AS d, CASE WHEN m >= 1200 THEN 'ASIA' WHEN m >= 120 AND m < 300 THEN 'LONDON' WHEN m >= 570 AND m < 960 THEN 'NY' ELSE 'OFF' END AS session, arg_min(open, ts) AS fair
      FROM (SELECT *, hour(ts) * 60 + minute(ts) AS m FROM bars) GROUP BY 1, 2, 3),
    t AS (SELECT *, hour(entry_ts) * 60 + minute(entry_ts) AS m, CAST(entry_ts AS DATE) AS d FROM trades), u AS (SELECT *, CASE WHEN m >= 1200 THEN 'ASIA' WHEN m >= 120 AND m < 300 THEN 'LONDON' WHEN m >= 570 AND m < 960 THEN 'NY' ELSE 'OFF' END AS session FROM t)
    SELECT trade_id, u.session, CASE u.session WHEN 'ASIA' THEN m - 1200 WHEN 'LONDON' THEN m - 120 WHEN 'NY' THEN m - 570 ELSE 0 END AS elapsed,
    CASE WHEN u.session = 'OFF' THEN 'inf'::DOUBLE WHEN direction = 1 AND entry_price < fair AND initial_tp_price > fair THEN (fair - entry_price) / abs(initial_tp_price - entry_price)
      WHEN direction = -1 AND entry_price > fair AND initial_tp_price < fair THEN (entry_price - fair) / abs(initial_tp_price - entry_price) ELSE 'inf'::DOUBLE END AS beyond
    FROM u LEFT JOIN f ON f.symbol = u.symbol AND f.d = u.d AND f.session = u.session""")
def _(spark, sf):
    return U.filter_meta(trades(spark, sf), bars(spark, sf))


# --- trade sequences ----------------------------------------------------------------------------------

def run_trades(spark, sf):
    t = trades(spark, sf)
    return t.select("run_id", "trade_id", "entry_ts", "exit_ts", F.to_date("entry_ts").alias("date"), ((F.col("exit_price") - F.col("entry_price")) * F.col("direction")).alias("points"), F.abs(F.col("entry_price") - F.col("initial_sl_price")).alias("sl_distance"))


@query("dynamic_sizing", "trade_id:i contracts:i net:r equity:r", """WITH RECURSIVE t AS (SELECT run_id, trade_id, pnl_points AS p, abs(entry_price - initial_sl_price) AS sl, row_number() OVER (PARTITION BY run_id ORDER BY entry_ts, trade_id) AS n FROM pnl),
    w AS (SELECT run_id, trade_id, n, greatest(1, floor(100000 * 0.01::DOUBLE / (sl * 20))) AS contracts, greatest(1, floor(100000 * 0.01::DOUBLE / (sl * 20))) * (p * 20 - 4) AS net, 100000 + greatest(1, floor(100000 * 0.01::DOUBLE / (sl * 20))) * (p * 20 - 4) AS equity FROM t WHERE n = 1
      UNION ALL SELECT t.run_id, t.trade_id, t.n, greatest(1, trunc(w.equity * 0.01::DOUBLE / (t.sl * 20))), greatest(1, trunc(w.equity * 0.01::DOUBLE / (t.sl * 20))) * (t.p * 20 - 4), w.equity + greatest(1, trunc(w.equity * 0.01::DOUBLE / (t.sl * 20))) * (t.p * 20 - 4) FROM w JOIN t ON t.run_id = w.run_id AND t.n = w.n + 1)
    SELECT * FROM w""")
def _(spark, sf):
    return L.dynamic_sizing(run_trades(spark, sf), ["run_id"], ["entry_ts", "trade_id"], 100000.0, 0.01, commission=2.0)


_GATE = "w.k < 2 AND coalesce(list_sum(list_transform(list_filter(w.taken, lambda x: x.e <= t.entry_ts), lambda x: x.p)), 0) <= 0"


@query("session_pnl_gate", "trade_id:i allowed:b", f"""WITH RECURSIVE t AS (SELECT run_id, CAST(entry_ts AS DATE) AS d, hour(entry_ts) // 8 AS session, trade_id, entry_ts, exit_ts, pnl_points AS p,
      row_number() OVER (PARTITION BY run_id, CAST(entry_ts AS DATE), hour(entry_ts) // 8 ORDER BY entry_ts, trade_id) AS n FROM pnl),
    w AS (SELECT run_id, d, session, trade_id, n, true AS allowed, 1 AS k, [{{'e': exit_ts, 'p': p}}] AS taken FROM t WHERE n = 1
      UNION ALL SELECT t.run_id, t.d, t.session, t.trade_id, t.n, {_GATE}, w.k + ({_GATE})::INT, CASE WHEN {_GATE} THEN list_append(w.taken, {{'e': t.exit_ts, 'p': t.p}}) ELSE w.taken END
      FROM w JOIN t ON t.run_id = w.run_id AND t.d = w.d AND t.session = w.session AND t.n = w.n + 1)
    SELECT * FROM w""")
def _(spark, sf):
    t = run_trades(spark, sf).withColumn("session", F.floor(F.hour("entry_ts") / 8))
    return L.session_pnl_gate(t, ["run_id", "date", "session"], 2, True)


@query("daily_r_matrix", "slot:i date:d sum_r:r mean_sl:r n:i fired:b dollars:r", """WITH c AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM bars WHERE hour(ts) * 60 + minute(ts) BETWEEN 570 AND 1020), g AS (SELECT run_id % 4 AS slot, CAST(entry_ts AS DATE) AS date, sum(r_multiple) AS sum_r, avg(abs(entry_price - initial_sl_price)) AS mean_sl, count(*) AS n FROM pnl GROUP BY 1, 2)
    SELECT s.slot, c.date, coalesce(sum_r, 0) AS sum_r, mean_sl, coalesce(n, 0) AS n, n IS NOT NULL AS fired, CASE WHEN n IS NOT NULL THEN sum_r * 100 - n * 3.5 ELSE 0 END AS dollars FROM (VALUES (0), (1), (2), (3), (9)) s(slot), c LEFT JOIN g ON g.slot = s.slot AND g.date = c.date""")
def _(spark, sf):
    t = run_trades(spark, sf).withColumns({"slot": (F.col("run_id") % 4).cast("int"), "r": F.col("points") / F.col("sl_distance")})
    return RS.daily_r_matrix(t, B.trading_calendar(bars(spark, sf)), [0, 1, 2, 3, 9], "slot", 100.0, 3.5)
