"""Signal queries on the test bars."""
from __future__ import annotations

from barloom.plans import signals as Q
from barloom.plans.bindings import stored_bars
from barloom.plans.registry import cte, query

OUT = "symbol ts direction:i ref_price:r sl:r tp:r reason:s"
M = "hour(ts) * 60 + minute(ts)"
RTH = f"{M} BETWEEN 570 AND 959"

cte("atr_trunc", """SELECT s.symbol, s.ts, coalesce(sum(CASE WHEN p.n = greatest(2, s.n - 42) THEN p.tr ELSE p.tr / 14 END * pow((13.0/14)::DOUBLE, s.n - p.n)), 0) AS x
    FROM tr s LEFT JOIN tr p ON p.symbol = s.symbol AND p.n <= s.n AND p.n >= greatest(2, s.n - 42) GROUP BY 1, 2""")
cte("full_daily", """SELECT symbol, CAST(ts AS DATE) AS date, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close FROM bars GROUP BY 1, 2""")
cte("fdl", "SELECT *, row_number() OVER w AS k, lag(close) OVER w AS prev_close, lag(close, 2) OVER w AS prev2_close, greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) AS tr FROM full_daily WINDOW w AS (PARTITION BY symbol ORDER BY date)")


def tick(x: str) -> str:
    return f"round(round_even(({x}) / 0.25, 0) * 0.25, 10)"


def emit(source: str, way: str, ref: str, dist: str, rr: str, reason: str) -> str:
    return f"""SELECT symbol, ts, w AS direction, r AS ref_price, {tick('r - w * d')} AS sl, {tick('r + w * ' + rr + ' * d')} AS tp, '{reason}' AS reason
        FROM (SELECT *, {way} AS w, {ref} AS r, {dist} AS d FROM ({source}) src) q WHERE w <> 0"""


def cap(sql: str, part: str, k: int) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY ts) AS rn FROM ({sql}) e) WHERE rn <= {k}"


def atr_join(source: str, atr: str = "atr_tr", where: str = RTH) -> str:
    return f"SELECT b.*, a.x AS atr FROM {source} b JOIN {atr} a ON a.symbol = b.symbol AND a.ts = b.ts WHERE {where.replace('(ts)', '(b.ts)')} AND a.x > 0"


def gap_src(daily: str, at: int) -> str:
    return f"SELECT b.*, a.x AS atr, d.close AS pc FROM bars b JOIN atr_trunc a ON a.symbol = b.symbol AND a.ts = b.ts ASOF JOIN {daily} d ON d.symbol = b.symbol AND CAST(b.ts AS DATE) > d.date WHERE hour(b.ts) * 60 + minute(b.ts) = {at} AND d.close > 0"


RETURN = "CASE WHEN abs({0}) < 0.001 THEN 0 WHEN {0} > 0 THEN 1 ELSE -1 END"
cte("rsi_prev", "SELECT r.*, b.close, lag(rsi) OVER (PARTITION BY r.symbol ORDER BY r.n) AS prev FROM rsi14 r JOIN nbars b ON b.symbol = r.symbol AND b.n = r.n")
cte("ha_close", "SELECT h.*, b.close FROM ha_x h JOIN nbars b ON b.symbol = h.symbol AND b.n = h.n")
cte("dt_x", "SELECT *, lag(close) OVER w AS pc, lag(dt_upper) OVER w AS pu, lag(dt_lower) OVER w AS pl FROM (SELECT b.*, dt_upper, dt_lower FROM nbars b LEFT JOIN dthrust_full d ON d.symbol = b.symbol AND d.date = CAST(b.ts AS DATE)) WINDOW w AS (PARTITION BY symbol ORDER BY ts)")
cte("dthrust_full", """SELECT symbol, date, open + 0.5 * lag(r) OVER w AS dt_upper, open - 0.5 * lag(r) OVER w AS dt_lower FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY date) >= 4
      THEN greatest(max(high) OVER f - min(close) OVER f, max(close) OVER f - min(low) OVER f) END AS r FROM full_daily WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS 3 PRECEDING)) WINDOW w AS (PARTITION BY symbol ORDER BY date)""")
cte("pre", f"SELECT symbol, CAST(ts AS DATE) AS date, max(high) AS pre_high, min(low) AS pre_low FROM bars WHERE {M} >= 180 AND {M} < 570 GROUP BY 1, 2")
cte("pre_x", "SELECT b.*, pre_high, pre_low, lag(close) OVER (PARTITION BY b.symbol ORDER BY ts) AS pc FROM bars b LEFT JOIN pre p ON p.symbol = b.symbol AND p.date = CAST(b.ts AS DATE)")
cte("shape3", """SELECT b.*, a.x AS atr, lag(open) OVER w AS o, lag(high) OVER w AS h, lag(low) OVER w AS l, lag(close) OVER w AS c, lag(a.x) OVER w AS pa, lag(close, 2) OVER w AS c2, lag(close, 3) OVER w AS c3 FROM nbars b JOIN atr_tr a ON a.symbol = b.symbol AND a.n = b.n WINDOW w AS (PARTITION BY b.symbol ORDER BY b.n)""")
cte("star", f"""SELECT *, {tick('h + 0.5 * pa')} AS s_up, {tick('l - 0.5 * pa')} AS s_dn, CASE WHEN pa > 0 AND atr > 0 AND abs(o - c) < 0.5 * pa THEN
      CASE WHEN c >= o AND h - greatest(o, c) < abs(o - c) + 0.001 AND least(o, c) - l >= abs(o - c) + 0.001 AND c2 > c AND c3 > c2 AND close > c THEN 1
           WHEN (o >= c OR abs(o - c) < 0.1 * pa) AND least(o, c) - l < abs(o - c) + 0.001 AND h - greatest(o, c) >= abs(o - c) + 0.001 AND c2 < c AND c3 < c2 AND close < c THEN -1 ELSE 0 END ELSE 0 END AS w0 FROM shape3""")
cte("orb_src", f"""SELECT b.*, d.atr5, o.open AS orb_open FROM bars b ASOF JOIN (SELECT *, CASE WHEN k >= 5 THEN avg(tr) OVER (PARTITION BY symbol ORDER BY date ROWS 4 PRECEDING) END AS atr5 FROM fdl) d ON d.symbol = b.symbol AND CAST(b.ts AS DATE) > d.date
    JOIN (SELECT symbol, CAST(ts AS DATE) AS date, open FROM bars WHERE {M} = 570) o ON o.symbol = b.symbol AND o.date = CAST(b.ts AS DATE) WHERE hour(b.ts) * 60 + minute(b.ts) BETWEEN 600 AND 929 AND d.atr5 > 0""")
cte("ibs_src", """SELECT b.*, d.ibs, d.atr14 FROM bars b ASOF JOIN (SELECT *, CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0.5 END AS ibs, CASE WHEN k >= 14 THEN avg(tr) OVER (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING) END AS atr14 FROM fdl) d
    ON d.symbol = b.symbol AND CAST(b.ts AS DATE) > d.date WHERE hour(b.ts) * 60 + minute(b.ts) = 570 AND d.atr14 > 0""")
cte("gapsrc", gap_src("full_daily", 570))
cte("onm", f"""SELECT b.*, a.x AS atr, o.open / d.prev_close - 1 AS ret, CASE WHEN d.prev_close / d.prev2_close - 1 > 0 THEN 1 ELSE -1 END AS p, d.prev2_close FROM bars b JOIN atr_trunc a ON a.symbol = b.symbol AND a.ts = b.ts JOIN fdl d ON d.symbol = b.symbol AND d.date = CAST(b.ts AS DATE)
    JOIN (SELECT symbol, CAST(ts AS DATE) AS date, open FROM bars WHERE {M} = 510) o ON o.symbol = b.symbol AND o.date = CAST(b.ts AS DATE) WHERE hour(b.ts) * 60 + minute(b.ts) = 900 AND d.prev_close IS NOT NULL""")
cte("winsrc", f"""SELECT b.*, a.x AS atr, g.ret FROM bars b JOIN atr_trunc a ON a.symbol = b.symbol AND a.ts = b.ts JOIN (SELECT symbol, CAST(ts AS DATE) AS date, arg_min(close, ts) FILTER ({M} >= 570) / max(open) FILTER ({M} = 510) - 1 AS ret FROM bars WHERE {M} >= 510 GROUP BY 1, 2) g
    ON g.symbol = b.symbol AND g.date = CAST(b.ts AS DATE) WHERE hour(b.ts) * 60 + minute(b.ts) = 900 AND ret IS NOT NULL""")
cte("ivsrc", f"""SELECT e.*, a.x AS atr, e.close / o.open - 1 AS ret FROM bars e JOIN atr_trunc a ON a.symbol = e.symbol AND a.ts = e.ts JOIN bars o ON o.symbol = e.symbol AND o.ts = e.ts - INTERVAL 90 MINUTE
    WHERE hour(e.ts) * 60 + minute(e.ts) BETWEEN 660 AND 960 AND (hour(e.ts) * 60 + minute(e.ts) - 570) % 90 = 0""")
cte("noise_src", f"SELECT n.symbol, n.ts, n.close, op * (1 + 0.5 * dsd) AS u, op * (1 - 0.5 * dsd) AS l, a.x AS atr FROM noise n JOIN atr_trunc a ON a.symbol = n.symbol AND a.ts = n.ts WHERE hour(n.ts) * 60 + minute(n.ts) BETWEEN 570 AND 930 AND minute(n.ts) % 30 = 0")
cte("bos_bars", "SELECT symbol, bos_ts AS ts, bool_or(kind = 'H') AS bh, bool_or(kind = 'L') AS bl FROM bos GROUP BY 1, 2")
cte("fairp", f"""SELECT *, first_value(open) OVER (PARTITION BY symbol, CAST(ts AS DATE), session ORDER BY ts) AS fair FROM (SELECT *, CASE WHEN {M} >= 1200 THEN 'ASIA' WHEN {M} >= 120 AND {M} < 300 THEN 'LONDON' WHEN {M} >= 570 AND {M} < 960 THEN 'NY' END AS session FROM nbars) WHERE session IS NOT NULL""")
cte("amr", f"""SELECT f.*, bh, bl, {M.replace('(ts)', '(f.ts)')} - CASE session WHEN 'ASIA' THEN 1200 WHEN 'LONDON' THEN 120 ELSE 570 END AS el FROM fairp f JOIN bos_bars x ON x.symbol = f.symbol AND x.ts = f.ts JOIN atr_tr a ON a.symbol = f.symbol AND a.n = f.n WHERE a.x > 0""")
cte("asia_src", f"""SELECT b.*, a.x AS atr, pre_high, pre_low, sign(pre_close - pre_open) AS w FROM bars b JOIN atr_trunc a ON a.symbol = b.symbol AND a.ts = b.ts JOIN asia_range r ON r.symbol = b.symbol AND r.date = CAST(b.ts AS DATE) WHERE a.x > 0 AND pre_high - pre_low BETWEEN 0.1 * a.x AND 50 * a.x""")
cte("vwsrc", f"SELECT v.*, a.x AS atr FROM vwap v JOIN atr_first a ON a.symbol = v.symbol AND a.n = v.n WHERE a.x > 0 AND hour(v.ts) * 60 + minute(v.ts) BETWEEN 600 AND 929")
cte("trend_days", """SELECT symbol, date, close AS dc, CASE WHEN k >= 14 THEN avg(tr) OVER (w ROWS 13 PRECEDING) END AS atr14, CASE WHEN k >= 5 THEN avg(tr) OVER (w ROWS 4 PRECEDING) END AS atr5, CASE WHEN k >= 3 THEN avg(close) OVER (w ROWS 2 PRECEDING) END AS sf,
    CASE WHEN k >= 8 THEN avg(close) OVER (w ROWS 7 PRECEDING) END AS ss, CASE WHEN k >= 3 THEN max(high) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) END AS hh, CASE WHEN k >= 3 THEN min(low) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) END AS ll,
    lag(high) OVER w AS ph, lag(low) OVER w AS pl FROM fdl WINDOW w AS (PARTITION BY symbol ORDER BY date)""")
cte("trend_src", "SELECT b.*, d.* EXCLUDE (symbol, date) FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc, row_number() OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts) AS rn FROM bars) b ASOF JOIN trend_days d ON d.symbol = b.symbol AND CAST(b.ts AS DATE) > d.date")
cte("orb60", f"SELECT symbol, CAST(ts AS DATE) AS date, max(high) AS oh, min(low) AS ol, arg_min(open, ts) AS oo, arg_max(close, ts) AS oc FROM bars WHERE {M} >= 570 AND {M} < 630 GROUP BY 1, 2")
cte("orb_stop_src", f"""SELECT f.*, a.x AS atr, oh, ol, oo, oc FROM (SELECT *, row_number() OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts) AS rn FROM bars WHERE {M} >= 630) f JOIN atr_trunc a ON a.symbol = f.symbol AND a.ts = f.ts
    JOIN orb60 o ON o.symbol = f.symbol AND o.date = CAST(f.ts AS DATE) WHERE rn = 1 AND a.x > 0 AND oh > ol AND oh - ol BETWEEN 0.1::DOUBLE * a.x AND 5 * a.x""")
TREND = "CASE WHEN sf > ss AND {0} THEN 1 WHEN sf < ss AND {1} THEN -1 ELSE 0 END"

SQL = {
    "trend_following": f"""SELECT symbol, ts, w AS direction, open AS ref_price, {tick("CASE WHEN w = 1 THEN ph - 2 * atr14 ELSE pl + 2 * atr14 END")} AS sl, NULL::DOUBLE AS tp, 'trend' AS reason
        FROM (SELECT *, {TREND.format("dc > hh", "dc < ll")} AS w FROM trend_src WHERE rn = 1 AND atr14 > 0) WHERE w <> 0 AND ph IS NOT NULL""",
    "orb_trend": cap(emit(f"SELECT * FROM trend_src WHERE {M} BETWEEN 600 AND 929 AND atr5 > 0", TREND.format(f"close > {tick('pc + 0.1::DOUBLE * atr5')}", f"close < {tick('pc - 0.1::DOUBLE * atr5')}"), "open", "open * 0.1::DOUBLE", "2.0", "orb_trend"), "symbol, CAST(ts AS DATE)", 1),
    "orb_stop": emit("SELECT *, oc >= oo AS up FROM orb_stop_src", "CASE WHEN up THEN 1 ELSE -1 END", f"CASE WHEN up THEN {tick('oh + 0.25')} ELSE {tick('ol - 0.25')} END", tick("greatest(atr, 1)"), "2.0", "orb_stop"),
    "rsi_cross": emit(atr_join("rsi_prev"), "CASE WHEN rsi < 45 AND prev >= 45 THEN 1 WHEN rsi > 55 AND prev <= 55 THEN -1 ELSE 0 END", "close", "atr", "1.5", "rsi"),
    "sma_cross_entry": emit(atr_join("sma"), "cross_", "close", "atr", "1.5", "sma_cross"),
    "bollinger_entry": emit(atr_join("boll_x"), "CASE WHEN below THEN 1 WHEN above THEN -1 ELSE 0 END", "close", "atr", "1.5", "bollinger_mean_reversion"),
    "ao_entry": emit(atr_join("ao_x"), "zero_cross", "close", "atr", "1.5", "ao_zero_cross"),
    "heikin_ashi_entry": emit(atr_join("ha_close"), "flip", "close", "atr", "1.5", "heikin_ashi"),
    "dual_thrust_entry": emit(atr_join("dt_x", where=f"{M} BETWEEN 570 AND 929"), "CASE WHEN close > dt_upper AND pc <= pu THEN 1 WHEN close < dt_lower AND pc >= pl THEN -1 ELSE 0 END", "close", "atr", "1.5", "dual_thrust"),
    "shooting_star_hammer": emit(f"SELECT * FROM star WHERE {RTH} AND CASE WHEN w0 = -1 THEN s_up > close ELSE s_dn < close END", "w0", "close", "CASE WHEN w0 = -1 THEN s_up - close ELSE close - s_dn END", "2.0", "rejection_candle"),
    "pre_session_breakout": emit(atr_join("pre_x", where=f"{M} BETWEEN 570 AND 929"), "CASE WHEN close > pre_high AND pc <= pre_high THEN 1 WHEN close < pre_low AND pc >= pre_low THEN -1 ELSE 0 END", "close", "atr", "1.5", "pre_session_breakout"),
    "vwap_reversion": cap(emit("SELECT * FROM vwsrc", "CASE WHEN close - vwap < -atr THEN 1 WHEN close - vwap > atr THEN -1 ELSE 0 END", "close", "atr", "1.5", "vwap_reversion"), "symbol, CAST(ts AS DATE), direction", 1),
    "ibs_open": emit("SELECT * FROM ibs_src", "CASE WHEN ibs < 0.2 THEN 1 WHEN ibs > 0.8 THEN -1 ELSE 0 END", "open", "atr14", "1.5", "ibs"),
    "orb_atr": cap(emit("SELECT * FROM orb_src", f"CASE WHEN close >= {tick('orb_open + 0.1::DOUBLE * atr5')} THEN 1 WHEN close <= {tick('orb_open - 0.1::DOUBLE * atr5')} THEN -1 ELSE 0 END", "close", "atr5 * 0.25", "1.5", "orb_atr"), "symbol, CAST(ts AS DATE), direction", 1),
    "gap_fill": emit("SELECT *, open - pc AS g FROM gapsrc WHERE atr > 0 AND abs(open - pc) >= 1e-6 AND abs(open - pc) / atr BETWEEN 0.1 AND 10", "CASE WHEN g < 0 THEN 1 ELSE -1 END", "open", tick("greatest(abs(g) * 0.5, 1)"), "(abs(g) / d)", "gap_fill"),
    "overnight_reversal": emit(gap_src("rth_daily", 570), "-" + RETURN.format("((open - pc) / pc)"), "open", "atr", "1.5", "overnight_reversal"),
    "overnight_momentum": emit("SELECT *, " + RETURN.format("ret") + " AS z FROM onm", "CASE WHEN prev2_close IS NOT NULL AND p <> z THEN 0 ELSE z END", "close", "atr", "1.5", "overnight_momentum"),
    "last_hour_momentum": emit(gap_src("full_daily", 900), RETURN.format("(close / pc - 1)"), "close", "atr", "1.5", "last_hour_momentum"),
    "window_momentum": emit("SELECT * FROM winsrc", RETURN.format("ret"), "close", "atr", "1.5", "window_momentum"),
    "interval_momentum": cap(emit("SELECT * FROM ivsrc", RETURN.format("ret"), "close", "atr", "1.5", "interval_momentum"), "symbol, CAST(ts AS DATE)", 2),
    "noise_boundary": cap(emit("SELECT * FROM noise_src", "CASE WHEN close > u THEN 1 WHEN close < l THEN -1 ELSE 0 END", "CASE WHEN close > u THEN u ELSE l END", "atr", "2.0", "noise_boundary"), "symbol, CAST(ts AS DATE)", 1),
    "asia_range": emit(f"SELECT * EXCLUDE (w), w AS w0 FROM asia_src WHERE {M} = 120", "w0", tick("CASE WHEN w0 = 1 THEN pre_high + 0.25 ELSE pre_low - 0.25 END"), tick("greatest(atr, 1)"), "1.5", "asia_breakout"),
    "anchored_reversion": emit("SELECT * FROM amr WHERE el BETWEEN 0 AND 389", """CASE WHEN bh AND close >= open AND coalesce((close - open) / nullif(high - open, 0), 0) >= 0.5 AND (close < fair OR el <= 60) THEN 1
        WHEN bl AND close < open AND coalesce((open - close) / nullif(open - low, 0), 0) >= 0.5 AND (close > fair OR el <= 60) THEN -1 ELSE 0 END""", "close", "20.0::DOUBLE", "1.5", "anchored_reversion"),
    "every_n_bars": emit("SELECT * FROM nbars WHERE n % 20 = 0", "CASE WHEN (n // 20) % 2 = 0 THEN 1 ELSE -1 END", "close", "10.0::DOUBLE", "2.0", "every_n"),
}

PARAMS = {"anchored_reversion": {"n": 3}, "rsi_cross": {"low": 45.0, "high": 55.0}, "vwap_band_fade": {"k": 0.5, "ema": 40, "structure": 100.0}, "ibs_rsi_close": {"trend": False, "at": 930, "ema": 50}, "trend_following": {"fast": 3, "slow": 8, "lookback": 2}, "orb_trend": {"fast": 3, "slow": 8}}
for _name, _fn in Q.SIGNALS.items():
    def _make(name, fn):
        return lambda spark, sf: fn(stored_bars(spark, sf), **PARAMS.get(name, {}))
    query(_name, OUT, SQL.get(_name))(_make(_name, _fn))


@query("double_sweep_state", "symbol date:d bias:i lon_up lon_down ny_sweep", f"""WITH l AS (SELECT b.symbol, CAST(b.ts AS DATE) AS date, min(b.ts) FILTER (b.high > pre_high) AS lon_up, min(b.ts) FILTER (b.low < pre_low) AS lon_down, max(b.high) AS hi, min(b.low) AS lo
      FROM bars b JOIN asia_range r ON r.symbol = b.symbol AND r.date = CAST(b.ts AS DATE) WHERE hour(b.ts) * 60 + minute(b.ts) BETWEEN 120 AND 299 GROUP BY 1, 2),
    g AS (SELECT *, CASE WHEN lon_down IS NOT NULL AND lon_up IS NULL THEN 1 WHEN lon_up IS NOT NULL AND lon_down IS NULL THEN -1 ELSE 0 END AS bias FROM l)
    SELECT g.symbol, g.date, any_value(bias) AS bias, any_value(lon_up) AS lon_up, any_value(lon_down) AS lon_down, min(b.ts) FILTER ((bias = 1 AND b.low < lo) OR (bias = -1 AND b.high > hi)) AS ny_sweep
    FROM g JOIN bars b ON b.symbol = g.symbol AND CAST(b.ts AS DATE) = g.date AND hour(b.ts) * 60 + minute(b.ts) BETWEEN 570 AND 959 WHERE bias <> 0 GROUP BY 1, 2""")
def _(spark, sf):
    return Q.double_sweep_state(stored_bars(spark, sf))


@query("validated_levels", "symbol leg_ts type:s value:r price:r direction:i kind:s z_ts z_level:r")
def _(spark, sf):
    return Q.validated_levels(stored_bars(spark, sf))
