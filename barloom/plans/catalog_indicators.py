"""Indicator queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import bars as B
from barloom.operators import indicators as I
from barloom.plans.bindings import bars, daily
from barloom.plans.registry import cte, query

TR_SQL = "greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0))"
cte("tr", f"SELECT *, {TR_SQL} AS tr, close - lag(close) OVER w AS chg FROM nbars WINDOW w AS (PARTITION BY symbol ORDER BY ts)")


def _recur(b: str, a: str = "13.0/14", start: int = 1) -> str:
    """Closed form of x_t = a*x_{t-1} + b_t as an all-prior self join (small tables only)."""
    return f"""SELECT s.symbol, s.ts, s.n, sum(p.b * pow(({a})::DOUBLE, s.n - p.n)) AS x FROM nbars s JOIN ({b}) p ON p.symbol = s.symbol AND p.n <= s.n
        WHERE s.n >= {start} GROUP BY 1, 2, 3"""


cte("atr_first", _recur("SELECT symbol, n, CASE WHEN n = 1 THEN tr ELSE tr / 14 END AS b FROM tr"))
cte("atr_tr", _recur("SELECT symbol, n, CASE WHEN n < 14 THEN 0 WHEN n = 14 THEN avg(tr) OVER (PARTITION BY symbol ORDER BY n ROWS 13 PRECEDING) ELSE tr / 14 END AS b FROM tr"))
for _name, _variant, _sql in (
    ("atr_seed_first", "seed_first", "SELECT symbol, ts, x AS atr FROM atr_first"),
    ("atr_seed_mean_tr", "seed_mean_tr", "SELECT symbol, ts, x AS atr FROM atr_tr"),
    ("atr_seed_mean_range", "seed_mean_range", "SELECT symbol, ts, x AS atr FROM (" + _recur(
        "SELECT symbol, n, CASE WHEN n < 14 THEN 0 WHEN n = 14 THEN avg(high - low) OVER (PARTITION BY symbol ORDER BY n ROWS 13 PRECEDING) ELSE tr / 14 END AS b FROM tr") + ")"),
    ("atr_zero_state", "zero_state", "SELECT symbol, ts, x AS atr FROM (" + _recur("SELECT symbol, n, tr / 14 AS b FROM tr") + ")"),
    ("atr_ewm", "ewm", "SELECT symbol, ts, CASE WHEN n >= 14 THEN x END AS atr FROM atr_first"),
    ("atr_rolling", "rolling", "SELECT symbol, ts, CASE WHEN n >= 14 THEN avg(tr) OVER (PARTITION BY symbol ORDER BY n ROWS 13 PRECEDING) END AS atr FROM tr"),
    ("atr_mean_change", "mean_change", "SELECT symbol, ts, sum(coalesce(abs(chg), 0)) OVER (PARTITION BY symbol ORDER BY n ROWS 13 PRECEDING) / 14 AS atr FROM tr"),
    ("atr_truncated", "truncated", """SELECT s.symbol, s.ts, coalesce(sum(CASE WHEN p.n = greatest(2, s.n - 42) THEN p.tr ELSE p.tr / 14 END * pow((13.0/14)::DOUBLE, s.n - p.n)), 0) AS atr
        FROM tr s LEFT JOIN tr p ON p.symbol = s.symbol AND p.n <= s.n AND p.n >= greatest(2, s.n - 42) GROUP BY 1, 2"""),
):
    def _make(variant):
        return lambda spark, sf: I.atr(bars(spark, sf), variant)
    query(_name, "symbol ts atr:r", _sql)(_make(_variant))

cte("rsi14", """SELECT g.symbol, g.ts, g.n, CASE WHEN g.n <= 15 THEN 50 WHEN s.x > 1e-10 THEN 100 - 100 / (1 + g.x / s.x) ELSE 100 - 100 / 101.0 END AS rsi FROM ("""
    + _recur("SELECT symbol, n, CASE WHEN n < 15 THEN 0 WHEN n = 15 THEN avg(greatest(chg, 0)) OVER (PARTITION BY symbol ORDER BY n ROWS 13 PRECEDING) ELSE greatest(chg, 0) / 14 END AS b FROM tr")
    + ") g JOIN (" + _recur("SELECT symbol, n, CASE WHEN n < 15 THEN 0 WHEN n = 15 THEN avg(greatest(-chg, 0)) OVER (PARTITION BY symbol ORDER BY n ROWS 13 PRECEDING) ELSE greatest(-chg, 0) / 14 END AS b FROM tr")
    + ") s ON g.symbol = s.symbol AND g.n = s.n")


@query("rsi", "symbol ts rsi:r", "SELECT * FROM rsi14")
def _(spark, sf):
    return I.rsi(bars(spark, sf))


cte("sma", """SELECT *, CASE WHEN f > s AND lag(f) OVER w <= lag(s) OVER w THEN 1 WHEN f < s AND lag(f) OVER w >= lag(s) OVER w THEN -1 ELSE 0 END AS cross_
    FROM (SELECT *, CASE WHEN n >= 5 THEN avg(close) OVER (PARTITION BY symbol ORDER BY n ROWS 4 PRECEDING) END AS f,
      CASE WHEN n >= 20 THEN avg(close) OVER (PARTITION BY symbol ORDER BY n ROWS 19 PRECEDING) END AS s FROM nbars) WINDOW w AS (PARTITION BY symbol ORDER BY n)""")


@query("sma_cross", "symbol ts ma_fast:r ma_slow:r x:i", "SELECT symbol, ts, f AS ma_fast, s AS ma_slow, cross_ AS x FROM sma")
def _(spark, sf):
    return I.sma_cross(bars(spark, sf), 5, 20).withColumnRenamed("cross", "x")


cte("boll", """SELECT *, mid + 2 * sd AS upper, mid - 2 * sd AS lower FROM (SELECT *, CASE WHEN n >= 20 THEN avg(close) OVER f END AS mid,
    CASE WHEN n >= 20 THEN stddev_samp(close) OVER f END AS sd FROM nbars WINDOW f AS (PARTITION BY symbol ORDER BY n ROWS 19 PRECEDING))""")
cte("boll_x", """SELECT *, close < lower AND lag(close) OVER w >= lag(lower) OVER w AS below, close > upper AND lag(close) OVER w <= lag(upper) OVER w AS above
    FROM boll WINDOW w AS (PARTITION BY symbol ORDER BY n)""")


@query("bollinger", "symbol ts mid:r upper:r lower:r below:b above:b", "SELECT * FROM boll_x")
def _(spark, sf):
    return I.bollinger(bars(spark, sf))


cte("ao", """SELECT *, CASE WHEN n >= 34 THEN avg((high + low) / 2) OVER (PARTITION BY symbol ORDER BY n ROWS 4 PRECEDING)
    - avg((high + low) / 2) OVER (PARTITION BY symbol ORDER BY n ROWS 33 PRECEDING) END AS ao FROM nbars""")
cte("ao_x", """SELECT *, CASE WHEN a2 IS NULL THEN 0 WHEN ao > 0 AND a1 <= 0 THEN 1 WHEN ao < 0 AND a1 >= 0 THEN -1 ELSE 0 END AS zero_cross,
    CASE WHEN ao < 0 AND a1 < 0 AND a2 < 0 AND a1 < a2 AND ao > a1 THEN 1 WHEN ao > 0 AND a1 > 0 AND a2 > 0 AND a1 > a2 AND ao < a1 THEN -1 ELSE 0 END AS saucer
    FROM (SELECT *, lag(ao) OVER w AS a1, lag(ao, 2) OVER w AS a2 FROM ao WINDOW w AS (PARTITION BY symbol ORDER BY n))""")


@query("awesome_oscillator", "symbol ts ao:r zero_cross:i saucer:i", "SELECT * FROM ao_x")
def _(spark, sf):
    return I.awesome_oscillator(bars(spark, sf))


@query("donchian", "symbol ts don_high:r don_low:r", """SELECT symbol, ts, CASE WHEN n > 20 THEN max(high) OVER f END AS don_high, CASE WHEN n > 20 THEN min(low) OVER f END AS don_low
    FROM nbars WINDOW f AS (PARTITION BY symbol ORDER BY n ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
def _(spark, sf):
    return I.donchian(bars(spark, sf), 20)


cte("vwap", """SELECT *, CASE WHEN hour(ts) * 60 + minute(ts) >= 570 THEN sum((high + low + close) / 3 * volume) FILTER (hour(ts) * 60 + minute(ts) >= 570) OVER w
    / sum(volume) FILTER (hour(ts) * 60 + minute(ts) >= 570) OVER w END AS vwap FROM nbars WINDOW w AS (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts)""")


@query("vwap_session", "symbol ts vwap:r", "SELECT * FROM vwap")
def _(spark, sf):
    return I.vwap_session(bars(spark, sf))


cte("vband", """SELECT *, mid + 2 * sd AS band_upper, mid - 2 * sd AS band_lower FROM (SELECT s.symbol, s.ts, s.n, max(m.mid) AS mid,
      greatest(0.25, coalesce(nullif(sqrt(sum(p.volume * pow((p.high + p.low + p.close) / 3 - m.mid, 2)) / sum(p.volume)), 0), stddev_pop((p.high + p.low + p.close) / 3))) AS sd
    FROM nbars s JOIN nbars p ON p.symbol = s.symbol AND p.n BETWEEN s.n - 19 AND s.n
    JOIN (SELECT symbol, n, sum((high + low + close) / 3 * volume) OVER f / sum(volume) OVER f AS mid FROM nbars WINDOW f AS (PARTITION BY symbol ORDER BY n ROWS 19 PRECEDING)) m
      ON m.symbol = s.symbol AND m.n = s.n GROUP BY 1, 2, 3)""")


@query("vwap_bands", "symbol ts band_upper:r band_lower:r", "SELECT * FROM vband")
def _(spark, sf):
    return I.vwap_bands(bars(spark, sf), 20)


@query("rolling_median_filter", "symbol ts med:r", """SELECT symbol, ts, CASE WHEN n >= 20 THEN quantile_cont(high - low, 0.5) OVER (PARTITION BY symbol ORDER BY n ROWS 19 PRECEDING) END AS med FROM nbars""")
def _(spark, sf):
    return I.rolling_median(bars(spark, sf), F.col("high") - F.col("low"), 20)


def _ema_sql(period: int, reach: int) -> str:
    k = f"(2.0 / {period + 1})::DOUBLE"
    return f"""SELECT s.symbol, s.ts, s.n, sum(CASE WHEN p.n = greatest(1, s.n - {reach}) THEN p.close ELSE p.close * {k} END * pow(1 - {k}, s.n - p.n)) AS ema
        FROM nbars s JOIN nbars p ON p.symbol = s.symbol AND p.n BETWEEN s.n - {reach} AND s.n GROUP BY 1, 2, 3"""


cte("ema10", _ema_sql(10, 30))


@query("ema", "symbol ts ema:r", "SELECT * FROM ema10")
def _(spark, sf):
    return I.ema(bars(spark, sf), 10)


cte("ha", """SELECT symbol, ts, n, hc, ho, greatest(high, ho, hc) AS hh, least(low, ho, hc) AS hl FROM (SELECT b.symbol, b.ts, b.n, b.high, b.low, (b.open + b.high + b.low + b.close) / 4 AS hc, r.x AS ho FROM nbars b JOIN ("""
    + _recur("SELECT symbol, n, CASE WHEN n = 1 THEN open ELSE lag((open + high + low + close) / 4) OVER (PARTITION BY symbol ORDER BY n) / 2 END AS b FROM nbars", "0.5") + ") r ON r.symbol = b.symbol AND r.n = b.n)")
cte("ha_x", """SELECT *, CASE WHEN hc > ho AND lag(hc) OVER w <= lag(ho) OVER w THEN 1 WHEN hc < ho AND lag(hc) OVER w >= lag(ho) OVER w THEN -1 ELSE 0 END AS flip
    FROM ha WINDOW w AS (PARTITION BY symbol ORDER BY n)""")


@query("heikin_ashi", "symbol ts ha_open:r ha_close:r ha_high:r ha_low:r flip:i", "SELECT symbol, ts, ho AS ha_open, hc AS ha_close, hh AS ha_high, hl AS ha_low, flip FROM ha_x")
def _(spark, sf):
    return I.heikin_ashi(bars(spark, sf))


def sar_sql(source: str) -> str:
    """The parabolic stop of ``source`` (symbol, n, ts, high, low, close) by recursion over its rows."""
    return f"""SELECT * FROM (WITH RECURSIVE t AS ({source}),
    w AS (SELECT symbol, n, ts, 0.0::DOUBLE AS psar, 0 AS trend, 0.0::DOUBLE AS peak, 0.0::DOUBLE AS af, high AS h1, low AS l1, high AS h2, low AS l2, close AS c1 FROM t WHERE n = 1
      UNION ALL SELECT symbol, n, ts, CASE WHEN trend = 0 THEN CASE WHEN c > c1 THEN l1 ELSE h1 END WHEN turn THEN peak ELSE lv END,
        CASE WHEN trend = 0 THEN CASE WHEN c > c1 THEN 1 ELSE -1 END WHEN turn THEN -trend ELSE trend END,
        CASE WHEN trend = 0 THEN CASE WHEN c > c1 THEN hi ELSE lo END WHEN turn THEN CASE WHEN trend = 1 THEN lo ELSE hi END WHEN trend = 1 THEN greatest(peak, hi) ELSE least(peak, lo) END,
        CASE WHEN trend = 0 OR turn THEN 0.02::DOUBLE WHEN (trend = 1 AND hi > peak) OR (trend = -1 AND lo < peak) THEN least(0.2::DOUBLE, af + 0.02::DOUBLE) ELSE af END, hi, lo, h1, l1, c
      FROM (SELECT *, CASE WHEN trend = 1 THEN lv > lo ELSE lv < hi END AS turn FROM (
        SELECT t.symbol, t.n, t.ts, t.high AS hi, t.low AS lo, t.close AS c, w.trend, w.peak, w.af, w.h1, w.l1, w.c1,
          CASE WHEN w.trend = 1 THEN least(w.psar + w.af * (w.peak - w.psar), w.l1, w.l2) ELSE greatest(w.psar + w.af * (w.peak - w.psar), w.h1, w.h2) END AS lv
        FROM w JOIN t ON t.symbol = w.symbol AND t.n = w.n + 1)))
    SELECT * FROM w)"""


@query("parabolic_sar", "symbol ts psar:r trend:i", sar_sql("SELECT symbol, n, ts, high, low, close FROM nbars"))
def _(spark, sf):
    return I.parabolic_sar(bars(spark, sf))


cte("dlag", """SELECT *, lag(open) OVER w AS prev_open, lag(close) OVER w AS prev_close, lag(high) OVER w AS prev_high, lag(low) OVER w AS prev_low, lag(close, 2) OVER w AS prev2_close,
    row_number() OVER w AS n FROM rth_daily WINDOW w AS (PARTITION BY symbol ORDER BY date)""")


@query("lag_features", "symbol date:d prev_close:r prev_high:r prev_low:r prev2_close:r overnight_return:r day_return:r prior_day_direction:i",
       """SELECT *, (open - prev_close) / prev_close AS overnight_return, (close - open) / open AS day_return, sign(prev_close - prev_open) AS prior_day_direction FROM dlag""")
def _(spark, sf):
    return I.lag_features(B.daily_bars(bars(spark, sf)))


@query("prior_day_direction", "symbol date:d prior_day_direction:i", "SELECT *, sign(prev_close - prev_open) AS prior_day_direction FROM dlag WHERE prev_close IS NOT NULL")
def _(spark, sf):
    return I.lag_features(B.daily_bars(bars(spark, sf))).where("prev_close is not null")


cte("dthrust", """SELECT symbol, date, open + 0.5 * lag(r) OVER w AS dt_upper, open - 0.5 * lag(r) OVER w AS dt_lower FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY date) >= 4
      THEN greatest(max(high) OVER f - min(close) OVER f, max(close) OVER f - min(low) OVER f) END AS r FROM rth_daily WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS 3 PRECEDING))
    WINDOW w AS (PARTITION BY symbol ORDER BY date)""")


@query("dual_thrust_levels", "symbol date:d dt_upper:r dt_lower:r", "SELECT * FROM dthrust")
def _(spark, sf):
    return I.dual_thrust_levels(B.daily_bars(bars(spark, sf)))


cte("noise", """SELECT symbol, ts, n, open, close, max(CASE WHEN m = 570 THEN open END) OVER d AS op, max(CASE WHEN m = 570 THEN sd END) OVER d AS dsd FROM (
    SELECT *, hour(ts) * 60 + minute(ts) AS m, CASE WHEN count(lr) OVER f >= 2 THEN stddev_pop(lr) OVER f * sqrt(13) END AS sd
      FROM (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY n)) AS lr FROM nbars) WINDOW f AS (PARTITION BY symbol ORDER BY n ROWS BETWEEN 65 PRECEDING AND 1 PRECEDING))
    WINDOW d AS (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts)""")


@query("noise_band", "symbol ts noise_upper:r noise_lower:r", "SELECT symbol, ts, op * (1 + dsd) AS noise_upper, op * (1 - dsd) AS noise_lower FROM noise")
def _(spark, sf):
    return I.noise_band(bars(spark, sf), 65, 13)


cte("orange", """SELECT symbol, CAST(ts AS DATE) AS date, max(high) AS or_high, min(low) AS or_low, arg_min(open, ts) AS or_open, arg_max(close, ts) AS or_close, count(*) AS or_bars
    FROM bars WHERE hour(ts) * 60 + minute(ts) BETWEEN 570 AND 629 GROUP BY 1, 2""")


@query("opening_range", "symbol date:d or_high:r or_low:r or_open:r or_close:r or_bars:i", "SELECT * FROM orange")
def _(spark, sf):
    return I.opening_range(bars(spark, sf), 60)


cte("iret", """SELECT *, lag(ret) OVER (PARTITION BY symbol, date ORDER BY slot) AS prev_ret FROM (SELECT symbol, CAST(ts AS DATE) AS date, (hour(ts) * 60 + minute(ts) - 570) // 90 AS slot,
    arg_max(close, ts) / arg_min(open, ts) - 1 AS ret, max(ts) AS end_ts FROM bars WHERE hour(ts) * 60 + minute(ts) BETWEEN 570 AND 959 GROUP BY 1, 2, 3)""")


@query("interval_returns", "symbol date:d slot:i ret:r prev_ret:r", "SELECT * FROM iret")
def _(spark, sf):
    return I.interval_returns(bars(spark, sf), 90)


@query("atr_pct_rank", "symbol date:d atr_rank:r", """WITH d AS (SELECT *, row_number() OVER w AS n, greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) AS tr
      FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY date)),
    a AS (SELECT s.symbol, s.date, s.n, CASE WHEN s.n >= 14 THEN sum(CASE WHEN p.n = 1 THEN p.tr ELSE p.tr / 14 END * pow((13.0 / 14)::DOUBLE, s.n - p.n)) END / max(s.close) * 100 AS v
      FROM d s JOIN d p ON p.symbol = s.symbol AND p.n <= s.n GROUP BY 1, 2, 3)
    SELECT s.symbol, s.date, CASE WHEN s.n <= 60 THEN 0.5 ELSE coalesce(count(*) FILTER (p.v < s.v) / nullif(count(p.v), 0), 0.5) END AS atr_rank
    FROM a s LEFT JOIN a p ON p.symbol = s.symbol AND p.n BETWEEN s.n - 60 AND s.n - 1 GROUP BY s.symbol, s.date, s.n""")
def _(spark, sf):
    return I.atr_pct_rank(daily(spark, sf))
