"""Queries over resampling, regimes, rankings and set operations."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions import trade as T
from barloom.operators import bars as B
from barloom.operators import clean as C
from barloom.operators import perf as P
from barloom.operators import regime as G
from barloom.operators import resample as RS
from barloom.operators import sets as U
from barloom.plans.bindings import bars, daily, r_trades, table, trades
from barloom.plans.registry import cte, query

SIMS, PERMS = 2000, 5000  # as many as the reference draws


def hx(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 12))::BIGINT"


def pnl(spark, sf):
    return T.with_trade_pnl(trades(spark, sf)).select("symbol", "trade_id", "exit_ts", F.col("net_pnl_dollars").alias("x"))


def mixer(name: str, h: str) -> str:
    """Columns ``name``0, ... of which ``name`` holds the 32 mixed bits of ``h``; see ``resample.mixed``."""
    return f"""({h}) & 4294967295::UBIGINT AS {name}0, (xor({name}0, {name}0 >> 15) * {RS.B}::UBIGINT) & 4294967295::UBIGINT AS {name}1,
      (xor({name}1, {name}1 >> 13) * {RS.C}::UBIGINT) & 4294967295::UBIGINT AS {name}2, xor({name}2, {name}2 >> 16) AS {name}"""


def seeds(keys: str, source: str, sims: int, seed: int = 42) -> str:
    """For each key and simulation the two hashed starts of its draws."""
    return f"""SELECT {keys}, sim, {mixer('a', f'sim::UBIGINT * {RS.A}::UBIGINT + (code & 4294967295)::UBIGINT')}, {mixer('b', f'sim::UBIGINT * {RS.B}::UBIGINT + (code >> 16)::UBIGINT')}
      FROM (SELECT *, {hx(f"'{seed}:' || {keys}")} AS code FROM (SELECT DISTINCT {keys} FROM {source})), range(0, {sims}) r(sim)"""


BITS = f"""{mixer('hi', f'a + ((step::UBIGINT * {RS.A}::UBIGINT) & 4294967295::UBIGINT)')}, {mixer('lo', f'b + ((step::UBIGINT * {RS.C}::UBIGINT) & 4294967295::UBIGINT)')}, (hi << 21) | (lo >> 11) AS u"""
cte("pk", "SELECT symbol, trade_id, net AS x, row_number() OVER (PARTITION BY symbol ORDER BY exit_ts, trade_id) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM pnl")
cte("bseed", seeds("symbol", "pk", SIMS))
cte("boot", f"SELECT a.symbol, sim, a.step + 1 AS draw, p.x FROM (SELECT symbol, sim, step, u % n + 1 AS idx FROM (SELECT symbol, sim, step, n, {BITS} FROM (SELECT symbol, k - 1 AS step, n FROM pk) JOIN bseed USING (symbol))) a JOIN pk p ON p.symbol = a.symbol AND p.k = a.idx")
cte("bpath", """SELECT *, (equity - peak) / CASE WHEN peak = 0 THEN 1 ELSE peak END AS dd_pct FROM (SELECT *, greatest(100000.0::DOUBLE, max(equity) OVER (PARTITION BY symbol, sim ORDER BY draw)) AS peak FROM (
    SELECT *, 100000.0::DOUBLE + sum(x) OVER (PARTITION BY symbol, sim ORDER BY draw) AS equity FROM boot))""")
cte("bsum", "SELECT symbol, sim, arg_max(equity, draw) AS final_equity, min(dd_pct) AS max_dd_pct, avg(x) AS mean, avg((x > 0)::INT) AS win_rate, sum(x) FILTER (x > 0) / -sum(x) FILTER (x < 0) AS profit_factor FROM bpath GROUP BY 1, 2")


def trade_blocks(spark, sf):
    return RS.value_blocks(pnl(spark, sf), ["symbol"], ["exit_ts", "trade_id"], "x")


def paths(spark, sf, how="bootstrap"):
    return RS.simulated_paths(trade_blocks(spark, sf), ["symbol"], SIMS, 100000.0, how)


PATH = "symbol sim:i final_equity:r max_dd_pct:r mean:r win_rate:r profit_factor:r"


@query("bootstrap_trades", PATH, "SELECT * FROM bsum")
def _(spark, sf):
    return paths(spark, sf).summary()


@query("shuffle_trades", PATH)
def _(spark, sf):
    """Random orders come from a network of hashes that SQL has no short form for; tests hold them against numpy."""
    return paths(spark, sf, "shuffle").summary()


def rank(p: int) -> int:
    return round(p / 100 * (SIMS - 1)) + 1


@query("bootstrap_fan", "symbol draw:i p5:r p25:r p50:r p75:r p95:r", "SELECT symbol, draw, " + ", ".join(f"e[{rank(p)}] AS p{p}" for p in (5, 25, 50, 75, 95)) + " FROM (SELECT symbol, draw, list_sort(list(equity)) AS e FROM bpath GROUP BY 1, 2)")
def _(spark, sf):
    return paths(spark, sf).fan()


@query("bootstrap_pvalue", "symbol p_value:r")
def _(spark, sf):
    """Draws are numbers per block from a binomial split, without SQL; tests hold them against draws one by one."""
    return RS.bootstrap_pvalue(RS.bootstrap_sums(trade_blocks(spark, sf), ["symbol"], SIMS), ["symbol"])


CI = ["win_rate", "mean", "profit_factor", "max_dd_pct", "sharpe"]
# Dollars a trading day, days without trades as 0, and the annual Sharpe of each simulation of such days.
cte("scal", "SELECT DISTINCT CAST(ts AS DATE) AS date FROM bars WHERE hour(ts) * 60 + minute(ts) BETWEEN 570 AND 1020")
cte("schg", """SELECT symbol, date, sum(net) AS chg FROM (SELECT p.symbol, coalesce((SELECT min(c.date) FROM scal c WHERE c.date >= CAST(p.exit_ts AS DATE)), (SELECT max(c.date) FROM scal c)) AS date, net
    FROM (SELECT symbol, exit_ts, net FROM pnl) p) GROUP BY 1, 2""")
cte("sdays", """SELECT s.symbol, coalesce(d.chg, 0) AS x, row_number() OVER (PARTITION BY s.symbol ORDER BY c.date) AS k, count(*) OVER (PARTITION BY s.symbol) AS n
    FROM (SELECT DISTINCT symbol FROM pnl) s CROSS JOIN scal c LEFT JOIN schg d ON d.symbol = s.symbol AND d.date = c.date""")
cte("sseed", seeds("symbol", "sdays", SIMS, 43))
cte("ssum", f"""SELECT a.symbol, sim, CASE WHEN stddev_pop(p.x) > 0 THEN avg(p.x) / stddev_pop(p.x) * sqrt(252) END AS sharpe FROM (SELECT symbol, sim, u % n + 1 AS idx FROM (SELECT symbol, sim, n, {BITS} FROM (SELECT symbol, k - 1 AS step, n FROM sdays) JOIN sseed USING (symbol))) a
    JOIN sdays p ON p.symbol = a.symbol AND p.k = a.idx GROUP BY 1, 2""")


def sharpes(spark, sf):
    """(symbol, sim, sharpe) of resampled dollars of all trading days, those without trades too."""
    cal = B.trading_calendar(bars(spark, sf))
    d = P.daily_pnl(T.with_trade_pnl(trades(spark, sf)), ["symbol"])
    dense = d.select("symbol").distinct().crossJoin(cal).join(P.on_calendar(d, cal, ["symbol"]), ["symbol", "date"], "left")
    dense = dense.select("symbol", "date", F.coalesce("pnl", F.lit(0.0)).alias("x"))
    blocks = RS.value_blocks(dense, ["symbol"], ["date"], "x", 43, F.trunc("date", "year"))
    return RS.annual_sharpe(RS.simulated_paths(blocks, ["symbol"], SIMS, 0.0).moments(), ["symbol"])


@query("bootstrap_ci", "symbol " + " ".join(f"{m}_lo:r {m}_hi:r" for m in CI), "SELECT symbol, " + ", ".join(f"CASE WHEN count({m}) >= {2 if m == 'profit_factor' else 1} THEN quantile_cont({m}, {p}::DOUBLE) ELSE 0 END AS {m}_{n}" for m in CI for p, n in ((0.025, "lo"), (0.975, "hi")))
       + " FROM bsum LEFT JOIN ssum USING (symbol, sim) GROUP BY 1")
def _(spark, sf):
    """Of trades: win rate, mean, profit factor and deepest drawdown; of days: the Sharpe ratio."""
    return RS.confidence_intervals(paths(spark, sf).summary().join(sharpes(spark, sf), ["symbol", "sim"], "left"), ["symbol"], CI)


@query("bootstrap_sharpe_ci", "symbol sharpe_lo:r sharpe_hi:r")
def _(spark, sf):
    """As ``bootstrap_pvalue``, over days."""
    days = pnl(spark, sf).groupBy("symbol", F.to_date("exit_ts").alias("date")).agg(F.sum("x").alias("x"))
    blocks = RS.value_blocks(days, ["symbol"], ["date"], "x", block=F.trunc("date", "year"))
    return RS.confidence_intervals(RS.annual_sharpe(RS.bootstrap_sums(blocks, ["symbol"], SIMS), ["symbol"]), ["symbol"], ["sharpe"])


def day_labels(spark, sf):
    """Three-state label of each order day by its mean R (a stand-in for fitted regimes, known to both engines)."""
    g = r_trades(spark, sf).groupBy("date").agg(F.avg("r").alias("m"))
    return g.select("date", F.when(F.col("m") < -0.2, 0).when(F.col("m") > 0.2, 2).otherwise(1).alias("label"))


cte("dlabels", "SELECT date, CASE WHEN avg(r) < -0.2 THEN 0 WHEN avg(r) > 0.2 THEN 2 ELSE 1 END AS label FROM r_trades GROUP BY 1")
cte("labelled", "SELECT t.*, coalesce(l.label, 1) AS label FROM r_trades t LEFT JOIN (SELECT * FROM dlabels WHERE month(date) <> 7) l USING (date)")
SH = "coalesce(CASE WHEN count({0}) >= 2 AND stddev_pop({0}) > 0 THEN avg({0}) / stddev_pop({0}) * sqrt(252) END, 0)"


def labelled(spark, sf):
    return G.label_trades(r_trades(spark, sf), day_labels(spark, sf).where(F.month("date") != 7))


@query("date_label_join", "trade_id:i label:i", "SELECT * FROM labelled")
def _(spark, sf):
    return labelled(spark, sf)


@query("regime_breakdown", "label:i n:i win_rate:r avg_pnl:r total_pnl:r sharpe:r expectancy_r:r", f"""SELECT d.label, count(r) AS n, coalesce(avg((r > 0)::INT), 0) AS win_rate, coalesce(avg(r), 0) AS avg_pnl, coalesce(sum(r), 0) AS total_pnl, {SH.format('r')} AS sharpe,
    coalesce(avg(r) / coalesce(avg(-r) FILTER (r < 0), 1), 0) AS expectancy_r FROM (VALUES (0), (1), (2), (3)) d(label) LEFT JOIN labelled l ON l.label = d.label GROUP BY 1""")
def _(spark, sf):
    return G.regime_breakdown(labelled(spark, sf), [0, 1, 2, 3], "r")


@query("is_oos_regime", "config_idx:i is_all:r is_filtered:r oos_all:r oos_filtered:r", f"""SELECT config_idx, {SH.format('a')} AS is_all, {SH.format('b')} AS is_filtered, {SH.format('c')} AS oos_all, {SH.format('d')} AS oos_filtered FROM (SELECT config_idx, CASE WHEN NOT o THEN r END AS a, CASE WHEN NOT o AND k THEN r END AS b,
    CASE WHEN o THEN r END AS c, CASE WHEN o AND k THEN r END AS d FROM (SELECT *, date >= DATE '1999-01-01' AS o, label IN (1, 2) AS k FROM labelled)) GROUP BY 1""")
def _(spark, sf):
    return G.is_oos_regime(labelled(spark, sf), ["config_idx"], "1999-01-01", [1, 2], "r")


def series_labels(spark, sf):
    d = daily(spark, sf)
    up = (F.col("close") - F.col("open")) / F.col("open")
    return d.select("symbol", "date", F.when(up < -0.1, 0).when(up > 0.1, 2).otherwise(1).alias("label"))


cte("slabels", "SELECT symbol, date, CASE WHEN (close - open) / open < -0.1 THEN 0 WHEN (close - open) / open > 0.1 THEN 2 ELSE 1 END AS label FROM daily")


@query("transition_matrix", "symbol from_label:i to_label:i n:i p:r stay_days:r", """SELECT symbol, f AS from_label, t AS to_label, n, p, CASE WHEN f = t THEN 1 / (1 - p) END AS stay_days FROM (SELECT symbol, f, t, n, n / sum(n) OVER (PARTITION BY symbol, f) AS p FROM (SELECT s.symbol, f, t, count(x.symbol) AS n FROM (SELECT DISTINCT symbol FROM slabels) s, range(0, 3) a(f), range(0, 3) b(t)
    LEFT JOIN (SELECT symbol, label, lead(label) OVER (PARTITION BY symbol ORDER BY date) AS nxt FROM slabels) x ON x.symbol = s.symbol AND x.label = f AND x.nxt = t GROUP BY 1, 2, 3))""")
def _(spark, sf):
    return G.transition_matrix(series_labels(spark, sf), ["symbol"], 3).withColumnsRenamed({"from": "from_label", "to": "to_label"})


@query("initial_distribution", "symbol label:i share:r", "SELECT symbol, label, count(*) / sum(count(*)) OVER (PARTITION BY symbol) AS share FROM slabels GROUP BY 1, 2")
def _(spark, sf):
    return G.initial_distribution(series_labels(spark, sf), ["symbol"])


@query("vol_regime_probability", "symbol date:d p_high:r", """WITH p AS (SELECT *, lag(label) OVER w AS prev, row_number() OVER w AS n FROM slabels WINDOW w AS (PARTITION BY symbol ORDER BY date))
    SELECT s.symbol, s.date, CASE WHEN any_value(s.prev) IS NULL THEN 1 / 3.0::DOUBLE ELSE (count(*) FILTER (h.prev = s.prev AND h.label = 2) + 1) / (count(*) FILTER (h.prev = s.prev) + 3)::DOUBLE END AS p_high
    FROM p s LEFT JOIN p h ON h.symbol = s.symbol AND h.n < s.n GROUP BY 1, 2""")
def _(spark, sf):
    return G.vol_regime_probability(series_labels(spark, sf), ["symbol"])


cte("pdays", "SELECT config_idx, date, count(*) AS n, sum(r) AS s, sum(r * r) AS q, row_number() OVER (PARTITION BY config_idx ORDER BY date) AS k FROM r_trades GROUP BY 1, 2")
cte("pseed", seeds("config_idx", "pdays", PERMS))


@query("permutation_test", "config_idx:i p_value:r actual_gain:r mean_gain:r", f"""WITH l AS (SELECT d.*, label IN (1, 2) AS ok FROM pdays d JOIN dlabels USING (date)),
    sh AS (SELECT config_idx, sim AS perm, ok, row_number() OVER (PARTITION BY config_idx, sim ORDER BY u, step) AS k FROM (SELECT config_idx, sim, ok, step, {BITS} FROM (SELECT config_idx, ok, k - 1 AS step FROM l) JOIN pseed USING (config_idx))),
    z AS (SELECT config_idx, perm, d.n, d.s, d.q FROM pdays d JOIN sh USING (config_idx, k) WHERE ok UNION ALL SELECT config_idx, -1, n, s, q FROM l WHERE ok),
    f AS (SELECT config_idx, perm, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM z GROUP BY 1, 2), a AS (SELECT config_idx, sum(s) / sum(n) / sqrt(sum(q) / sum(n) - pow(sum(s) / sum(n), 2)) * sqrt(252) AS whole FROM l GROUP BY 1),
    g AS (SELECT config_idx, perm, (s / n) / sqrt(q / n - pow(s / n, 2)) * sqrt(252) - whole AS gain FROM f JOIN a USING (config_idx))
    SELECT g.config_idx, avg((g.gain >= x.gain)::INT) AS p_value, any_value(x.gain) AS actual_gain, avg(g.gain) AS mean_gain FROM g JOIN g x ON x.config_idx = g.config_idx AND x.perm = -1 WHERE g.perm >= 0 GROUP BY 1""")
def _(spark, sf):
    return RS.permutation_test(r_trades(spark, sf), day_labels(spark, sf), ["config_idx"], [1, 2], PERMS, value="r")


def block_bits(what: str) -> str:
    return f"""SELECT sim, step, u FROM (SELECT sim, step, {BITS} FROM (SELECT sim, {mixer('a', f'sim::UBIGINT * {RS.A}::UBIGINT + (code & 4294967295)::UBIGINT')}, {mixer('b', f'sim::UBIGINT * {RS.B}::UBIGINT + (code >> 16)::UBIGINT')}
      FROM (SELECT {hx(f"'42:{what}'")} AS code), range(0, {SIMS}) r(sim)), range(0, (SELECT count(DISTINCT date) FROM daily)) q(step))"""


cte("bbreak", block_bits("break"))
cte("bstart", block_bits("start"))
cte("bpos", """SELECT b.symbol, b.sim, b.step, b.b0, (s.u::BIGINT % n + b.step - b0) % n AS pos FROM (SELECT *, max(CASE WHEN step = 0 OR u / 9007199254740992.0::DOUBLE < 0.1::DOUBLE THEN step END) OVER (PARTITION BY symbol, sim ORDER BY step) AS b0
      FROM (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS step, count(*) OVER (PARTITION BY symbol) AS n FROM daily) JOIN bbreak USING (step)) b JOIN bstart s ON s.sim = b.sim AND s.step = b.b0""")


@query("block_bootstrap", "symbol sim:i steps:i breaks:i pos_sum:i step_pos_sum:i", "SELECT symbol, sim, count(*) AS steps, count(DISTINCT b0) AS breaks, sum(pos) AS pos_sum, sum(step * pos) AS step_pos_sum FROM bpos GROUP BY 1, 2")
def _(spark, sf):
    """Of every simulation's positions their number, that of its blocks (jumps and the start), and two sums over all of them."""
    d = RS.block_bootstrap(daily(spark, sf), ["symbol"], "date", SIMS, 10.0)
    return d.groupBy("symbol", "sim").agg(F.count(F.lit(1)).alias("steps"), F.sum((F.col("step") == F.col("block_start")).cast("long")).alias("breaks"), F.sum("pos").alias("pos_sum"), F.sum(F.col("step") * F.col("pos")).alias("step_pos_sum"))


@query("block_bootstrap_equity", "symbol sim:i total:r", """SELECT b.symbol, sim, sum(x) AS total FROM bpos b JOIN (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS pos, ln(close / open) AS x FROM daily) d ON d.symbol = b.symbol AND d.pos = b.pos GROUP BY 1, 2""")
def _(spark, sf):
    """Shared day draws joined to the series' own day returns."""
    d = daily(spark, sf)
    pos = d.select("symbol", (F.row_number().over(Window.partitionBy("symbol").orderBy("date")) - 1).alias("pos"), F.ln(F.col("close") / F.col("open")).alias("x"))
    return RS.block_bootstrap(d, ["symbol"], "date", SIMS, 10.0).join(pos, ["symbol", "pos"]).groupBy("symbol", "sim").agg(F.sum("x").alias("total"))


@query("regime_labels", "symbol date:d label:i in_sample:b")
def _(spark, sf):
    d = daily(spark, sf).withColumn("lr", F.ln(F.col("close") / F.col("open")))
    return G.regime_labels(d, ["symbol"], "lr")


@query("vol_regime", "symbol date:d label:i in_sample:b p_high:r")
def _(spark, sf):
    return G.vol_regime(daily(spark, sf), ["symbol"], train_ratio=0.4)


@query("trade_pool_by_regime", "config_idx:i pool:i n:i total:r", """WITH x AS (SELECT config_idx, label, count(*) AS n, sum(r) AS total FROM labelled WHERE NOT (config_idx % 3 = 0 AND label = 0) GROUP BY 1, 2)
    SELECT c.config_idx, p AS pool, coalesce(x.n, a.n) AS n, coalesce(x.total, a.total) AS total FROM (SELECT DISTINCT config_idx FROM x) c CROSS JOIN range(0, 3) r(p) LEFT JOIN x ON x.config_idx = c.config_idx AND x.label = p LEFT JOIN (SELECT config_idx, sum(n) AS n, sum(total) AS total FROM x GROUP BY 1) a ON a.config_idx = c.config_idx""")
def _(spark, sf):
    from barloom.operators.sweeps import trade_pools
    labels = day_labels(spark, sf).where(F.month("date") != 7)
    t = G.label_trades(r_trades(spark, sf), labels).where(~((F.col("config_idx") % 3 == 0) & (F.col("label") == 0))).drop("label")
    return trade_pools(t, labels, "config_idx", [0, 1, 2]).groupBy("config_idx", "pool").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("total"))


# --- ranking and sets --------------------------------------------------------------------------------

@query("top_n_per_group", "symbol kind:s trade_id:i", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, kind ORDER BY rng DESC, dist, trade_id) AS rn FROM (SELECT symbol, exit_reason AS kind, trade_id, abs(exit_price - entry_price) AS rng, abs(entry_price - 50) AS dist FROM trades)) WHERE rn <= 3""")
def _(spark, sf):
    t = trades(spark, sf).withColumns({"kind": F.col("exit_reason"), "rng": F.abs(F.col("exit_price") - F.col("entry_price")), "dist": F.abs(F.col("entry_price") - 50)})
    return U.top_n_per_group(t, ["symbol", "kind"], [F.desc("rng"), F.col("dist"), F.col("trade_id")], 3)


@query("sample_points", "trade_id:i mae_points:r mfe_points:r", f"SELECT * FROM trades ORDER BY {hx('''0 || ':' || trade_id''')}, trade_id LIMIT 500")
def _(spark, sf):
    return U.sample_points(trades(spark, sf), "trade_id", 500)


@query("daily_signal_cap", "symbol ts direction:i", """SELECT symbol, ts, direction FROM (SELECT *, row_number() OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts) AS r3 FROM (SELECT *, row_number() OVER (PARTITION BY symbol, CAST(ts AS DATE), hour(ts) // 4 ORDER BY ts) AS r2 FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol, CAST(ts AS DATE), direction ORDER BY ts) AS r1 FROM (SELECT symbol, ts, CASE WHEN close > open THEN 1 ELSE -1 END AS direction FROM bars)) WHERE r1 <= 3) WHERE r2 <= 1) WHERE r3 <= 2""")
def _(spark, sf):
    s = bars(spark, sf).select("symbol", "ts", F.when(F.col("close") > F.col("open"), 1).otherwise(-1).alias("direction"))
    return U.daily_signal_cap(s, ["symbol"], per_day=2, per_side=3, per_hours=(4, 1))


@query("dedup_levels", "symbol direction:i ts price:r", """SELECT symbol, direction, ts, price FROM (SELECT *, row_number() OVER (PARTITION BY symbol, round_even(price, 2), direction ORDER BY ts) AS rn FROM (SELECT symbol, ts, close AS price, CASE WHEN close > open THEN 1 ELSE -1 END AS direction FROM bars)) WHERE rn = 1""")
def _(spark, sf):
    lv = bars(spark, sf).select("symbol", "ts", F.col("close").alias("price"), F.when(F.col("close") > F.col("open"), 1).otherwise(-1).alias("direction"))
    return U.dedup_levels(lv, ["symbol"], "price", ["ts"])


RECORD = """'{"trade_id":' || trade_id || ',"direction":' || direction || ',"exit_reason":"' || exit_reason || '"}'"""


@query("trade_set_fingerprint", "run_id:i n:i digest:s", f"""WITH d AS (SELECT run_id, trade_id, sha256({RECORD}) AS h, (row_number() OVER (PARTITION BY run_id ORDER BY trade_id) - 1) // {U.RANGE} AS k FROM trades),
    r AS (SELECT run_id, k, count(*) AS n, sha256(string_agg(h, '' ORDER BY trade_id)) AS h FROM d GROUP BY 1, 2)
    SELECT run_id, sum(n) AS n, sha256(string_agg(h, '' ORDER BY k)) AS digest FROM r GROUP BY 1""")
def _(spark, sf):
    t = trades(spark, sf).withColumn("h", U.record_digest(["trade_id", "direction", "exit_reason"]))
    return U.ordered_digest(t, ["run_id"], "h", "trade_id")


@query("fingerprint_unordered", "run_id:i n:i xor_hash:i sum_hash:i", f"SELECT run_id, count(*) AS n, bit_xor(('0x' || substr(md5({RECORD}), 1, 12))::BIGINT) AS xor_hash, sum(('0x' || substr(md5({RECORD}), 13, 8))::BIGINT) AS sum_hash FROM trades GROUP BY 1")
def _(spark, sf):
    return U.fingerprint(trades(spark, sf), ["run_id"], ["trade_id", "direction", "exit_reason"])


@query("first_difference", "trade_id:i direction:i side:s", "SELECT trade_id, direction, 'expected' AS side FROM trades WHERE trade_id > 100 AND trade_id % 50 = 0 ORDER BY trade_id LIMIT 1")
def _(spark, sf):
    a = trades(spark, sf).select("trade_id", "direction")
    b = a.withColumn("direction", F.when((F.col("trade_id") > 100) & (F.col("trade_id") % 50 == 0), -F.col("direction")).otherwise(F.col("direction")))
    return U.first_difference(a, b, ["trade_id", F.desc("side")])


@query("outlier_dedup", "user_id:i event_id:i", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def _(spark, sf):
    return C.keep_last(table(spark, sf, "events").select("user_id", "event_id"), ["user_id"], ["event_id"])


@query("trading_days_per_symbol", "symbol days:i", "SELECT symbol, count(DISTINCT CAST(ts AS DATE)) AS days FROM bars WHERE hour(ts) * 60 + minute(ts) BETWEEN 570 AND 960 GROUP BY 1")
def _(spark, sf):
    return B.daily_bars(bars(spark, sf)).groupBy("symbol").agg(F.count(F.lit(1)).alias("days"))
