"""Queries over raw bars: cleaning, resampling, calendars, sessions."""
from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import scalar as S
from barloom.operators import bars as B
from barloom.operators import clean as C
from barloom.operators.joins import asof_join, prior_day_join
from barloom.plans.bindings import bars, daily, table, ticks
from barloom.plans.registry import cte, query


def raw_bars(spark, sf):
    """Bars with repeated timestamps and an ingestion number, as an uncleaned feed would have them."""
    e = table(spark, sf, "events")
    p = F.col("value")
    return e.select(
        F.col("event_type").alias("symbol"), F.date_trunc("minute", "ts").alias("ts"), F.col("event_id").alias("ingest_id"),
        p.alias("open"), (p + F.col("event_id") % 5 - 1.0).alias("high"), (p - F.col("event_id") % 7 + 0.0).alias("low"), p.alias("close"),
        (F.col("event_id") % 10).cast("double").alias("volume"))


cte("raw_bars", """SELECT event_type AS symbol, date_trunc('minute', ts) AS ts, event_id AS ingest_id, value AS open, value + event_id % 5 - 1.0 AS high,
    value - event_id % 7 + 0.0 AS low, value AS close, CAST(event_id % 10 AS DOUBLE) AS volume FROM events""")
cte("clean_bars", "SELECT * FROM raw_bars QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY ingest_id) = 1")
RULES_SQL = "volume = 0 OR high = low OR high - low > 200 OR high < open OR high < close OR low > open OR low > close"


@query("dedup_keep_first", "symbol ts ingest_id:i close:r", "SELECT * FROM clean_bars")
def _(spark, sf):
    return C.keep_first(raw_bars(spark, sf), ["symbol", "ts"], ["ingest_id"])


@query("flag_anomalous", "symbol ts ingest_id:i anomalous:b", f"SELECT *, ({RULES_SQL}) AS anomalous FROM raw_bars")
def _(spark, sf):
    return C.flag_anomalous(raw_bars(spark, sf))


cte("gaps", """SELECT *, CASE WHEN prev_ts IS NULL OR epoch(ts) - epoch(prev_ts) <= 60 OR hour(prev_ts) * 60 + minute(prev_ts) BETWEEN 955 AND 1085
      OR isodow(prev_ts) = 5 THEN NULL WHEN floor((epoch(ts) - epoch(prev_ts)) / 60) <= 5 THEN 'minor'
      WHEN floor((epoch(ts) - epoch(prev_ts)) / 60) <= 360 THEN 'session' ELSE 'large' END AS gap
    FROM (SELECT *, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS prev_ts FROM clean_bars)""")


@query("gap_detect", "symbol ts prev_ts gap:s", "SELECT * FROM gaps")
def _(spark, sf):
    return C.detect_gaps(C.keep_first(raw_bars(spark, sf), ["symbol", "ts"], ["ingest_id"]), 1)


@query("cleaning_report", "symbol rows_in:i rows_out:i duplicates:i gaps_minor:i gaps_session:i gaps_large:i zero_volume:i zero_range:i invalid_ohlc:i anomalous:i",
       f"""SELECT symbol, (SELECT count(*) FROM raw_bars r WHERE r.symbol = g.symbol) AS rows_in, count(*) AS rows_out,
           (SELECT count(*) FROM raw_bars r WHERE r.symbol = g.symbol) - count(*) AS duplicates,
           count(*) FILTER (gap = 'minor') AS gaps_minor, count(*) FILTER (gap = 'session') AS gaps_session, count(*) FILTER (gap = 'large') AS gaps_large,
           count(*) FILTER (volume = 0) AS zero_volume, count(*) FILTER (high = low) AS zero_range,
           count(*) FILTER (high < open OR high < close OR low > open OR low > close) AS invalid_ohlc,
           count(*) FILTER ({RULES_SQL}) AS anomalous FROM gaps g GROUP BY symbol""")
def _(spark, sf):
    return C.cleaning_report(raw_bars(spark, sf), 1)


@query("trim_partial", "symbol n:i first_ts", """SELECT symbol, count(*) AS n, min(ts) AS first_ts FROM
    (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM clean_bars) WHERE rn > 1 OR minute(ts) % 5 = 0 GROUP BY symbol""")
def _(spark, sf):
    d = C.trim_partial(C.keep_first(raw_bars(spark, sf), ["symbol", "ts"], ["ingest_id"]), 5)
    return d.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"))


@query("filter_dates", "symbol ts close:r", "SELECT * FROM bars WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-12 23:59:59'")
def _(spark, sf):
    t = ticks(spark, sf).where((F.col("ts") >= F.lit("2024-01-05").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-13").cast("timestamp_ntz")))
    return B.resample_ticks(t, 30, offset=0)


@query("time_window_filter", "symbol ts", """SELECT * FROM bars WHERE (hour(ts) * 60 + minute(ts)) BETWEEN 570 AND 660
    OR (hour(ts) * 60 + minute(ts)) >= 1320 OR (hour(ts) * 60 + minute(ts)) <= 60""")
def _(spark, sf):
    return bars(spark, sf).where(S.in_window("ts", 570, 660) | S.in_window("ts", 1320, 60))


@query("session_tag", "symbol session:s n:i vol:r", """SELECT symbol, CASE WHEN m >= 1200 THEN 'ASIA' WHEN m >= 120 AND m < 300 THEN 'LONDON'
    WHEN m >= 570 AND m < 960 THEN 'NY' ELSE 'OFF' END AS session, count(*) AS n, sum(volume) AS vol
    FROM (SELECT *, hour(ts) * 60 + minute(ts) AS m FROM bars) GROUP BY 1, 2""")
def _(spark, sf):
    return bars(spark, sf).groupBy("symbol", B.session_tag().alias("session")).agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("vol"))


@query("candidate_mask", "symbol ts open:r", "SELECT * FROM bars WHERE (hour(ts) = 9 AND minute(ts) = 30) OR (minute(ts) = 30 AND hour(ts) BETWEEN 10 AND 15)")
def _(spark, sf):
    m = S.minute_of_day()
    return bars(spark, sf).where((m == 570) | ((m % 60 == 30) & m.between(600, 959)))


@query("resample_ohlcv", "symbol ts open:r high:r low:r close:r volume:r close_ts", """SELECT symbol, time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '2000-01-01 02:00:00') AS ts,
    arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume, max(ts) AS close_ts FROM bars GROUP BY 1, 2""")
def _(spark, sf):
    return B.resample_ohlcv(bars(spark, sf), 240)


@query("resample_ticks", "symbol ts open:r high:r low:r close:r volume:r", "SELECT * FROM bars")
def _(spark, sf):
    return bars(spark, sf)


@query("resample_by_count", "symbol grp:i ts open:r high:r low:r close:r", """SELECT symbol, (n - 1) // 7 AS grp, min(ts) AS ts, arg_min(open, n) AS open, max(high) AS high,
    min(low) AS low, arg_max(close, n) AS close FROM nbars GROUP BY symbol, (n - 1) // 7 HAVING count(*) = 7""")
def _(spark, sf):
    return B.resample_by_count(bars(spark, sf), 7)


@query("resample_close_map", "symbol ts close_ts", "SELECT symbol, time_bucket(INTERVAL 60 MINUTE, ts) AS ts, max(ts) AS close_ts FROM bars GROUP BY 1, 2")
def _(spark, sf):
    return B.resample_ohlcv(bars(spark, sf), 60)


@query("trading_calendar", "date:d", "SELECT DISTINCT CAST(ts AS DATE) AS date FROM bars WHERE hour(ts) * 60 + minute(ts) BETWEEN 570 AND 1020")
def _(spark, sf):
    return B.trading_calendar(bars(spark, sf))


cte("rth_daily", """SELECT symbol, CAST(ts AS DATE) AS date, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close,
    sum(volume) AS volume, max(ts) AS last_ts FROM bars WHERE hour(ts) * 60 + minute(ts) BETWEEN 570 AND 960 GROUP BY 1, 2""")


@query("daily_bars", "symbol date:d open:r high:r low:r close:r volume:r last_ts", "SELECT * FROM rth_daily")
def _(spark, sf):
    return B.daily_bars(bars(spark, sf))


@query("eod_bar", "symbol date:d eod_ts", """SELECT symbol, CAST(ts AS DATE) AS date, coalesce(min(ts) FILTER (hour(ts) * 60 + minute(ts) >= 945), max(ts)) AS eod_ts
    FROM bars WHERE hour(ts) * 60 + minute(ts) BETWEEN 570 AND 960 GROUP BY 1, 2""")
def _(spark, sf):
    return B.eod_bars(bars(spark, sf), 945)


@query("session_levels", "symbol date:d kind:s age:i high:r low:r", """SELECT symbol, formed + CAST(a AS INT) AS date, kind, a AS age, high, low FROM (
    SELECT symbol, kind, CASE WHEN kind IN ('asia', 'prev_day') THEN CAST(ts AS DATE) + 1 ELSE CAST(ts AS DATE) END AS formed, max(high) AS high, min(low) AS low
    FROM bars JOIN (VALUES ('prev_day', 0, 1440), ('asia', 1200, 1440), ('london', 120, 300), ('ny_pre', 480, 570), ('ny_am', 570, 660),
      ('ny_lunch', 720, 780), ('ny_pm', 810, 960)) s(kind, a, b) ON hour(ts) * 60 + minute(ts) >= a AND hour(ts) * 60 + minute(ts) < b GROUP BY 1, 2, 3)
    JOIN (VALUES (0), (1), (2)) v(a) ON a = 0 OR kind <> 'prev_day'""")
def _(spark, sf):
    return B.session_levels(bars(spark, sf), 2)


@query("anchor_opens", "symbol date:d midnight_open:r week_open:r", """SELECT *, first_value(midnight_open) OVER (PARTITION BY symbol, date_trunc('week', date) ORDER BY date) AS week_open
    FROM (SELECT symbol, CAST(ts AS DATE) AS date, arg_min(open, ts) AS midnight_open FROM bars GROUP BY 1, 2)""")
def _(spark, sf):
    return B.anchor_opens(bars(spark, sf))


@query("running_day_extremes", "symbol ts day_high:r day_low:r", """SELECT symbol, ts, max(high) OVER w AS day_high, min(low) OVER w AS day_low FROM bars
    WINDOW w AS (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts)""")
def _(spark, sf):
    return B.running_day_extremes(bars(spark, sf))


cte("asia_range", """SELECT symbol, CASE WHEN m >= 1200 THEN CAST(ts AS DATE) + 1 ELSE CAST(ts AS DATE) END AS date, max(high) AS pre_high, min(low) AS pre_low,
    arg_min(open, ts) AS pre_open, arg_max(close, ts) AS pre_close, count(*) AS bars FROM (SELECT *, hour(ts) * 60 + minute(ts) AS m FROM bars)
    WHERE m >= 1200 OR m < 120 GROUP BY 1, 2""")


@query("pre_session_range", "symbol date:d pre_high:r pre_low:r pre_open:r pre_close:r bars:i", "SELECT * FROM asia_range")
def _(spark, sf):
    return B.pre_session_range(bars(spark, sf), 1200, 120)


@query("fair_price", "symbol ts session:s fair:r", """SELECT symbol, ts, session, CASE WHEN session <> 'OFF' THEN first_value(open) OVER (PARTITION BY symbol, CAST(ts AS DATE), session ORDER BY ts) END AS fair
    FROM (SELECT *, CASE WHEN m >= 1200 THEN 'ASIA' WHEN m >= 120 AND m < 300 THEN 'LONDON' WHEN m >= 570 AND m < 960 THEN 'NY' ELSE 'OFF' END AS session
          FROM (SELECT *, hour(ts) * 60 + minute(ts) AS m FROM bars))""")
def _(spark, sf):
    return B.fair_price(bars(spark, sf))


@query("asof_completed_bar", "symbol ts close:r c_ts c_close:r", """WITH c AS (SELECT symbol, time_bucket(INTERVAL 4 HOUR, ts) AS c_ts, arg_max(close, ts) AS c_close FROM bars GROUP BY 1, 2)
    SELECT b.symbol, b.ts, b.close, c.c_ts, c.c_close FROM bars b ASOF LEFT JOIN c ON b.symbol = c.symbol AND b.ts >= c.c_ts + INTERVAL 4 HOUR""")
def _(spark, sf):
    fine = bars(spark, sf)
    coarse = B.resample_ohlcv(fine, 240, offset=0).select("symbol", F.col("ts").alias("c_ts"), F.col("close").alias("c_close"))
    return asof_join(fine, coarse, ["symbol"], "ts", F.col("c_ts") + F.expr("INTERVAL 4 HOURS"), ["c_ts", "c_close"])


@query("asof_prior_day", "symbol ts d_close:r d_high:r", """SELECT b.symbol, b.ts, d.close AS d_close, d.high AS d_high FROM bars b
    ASOF LEFT JOIN rth_daily d ON b.symbol = d.symbol AND CAST(b.ts AS DATE) > d.date""")
def _(spark, sf):
    b = bars(spark, sf)
    d = B.daily_bars(b).select("symbol", "date", F.col("close").alias("d_close"), F.col("high").alias("d_high"))
    return prior_day_join(b, d, ["symbol"], "ts", "date", ["d_close", "d_high"])


@query("estimate_trades_per_day", "symbol n:i days:i tpd:r", """SELECT symbol, count(*) AS n, greatest(1, date_diff('day', CAST(min(entry_ts) AS DATE), CAST(max(entry_ts) AS DATE)) + 1) AS days,
    count(*) / greatest(1.0, date_diff('day', CAST(min(entry_ts) AS DATE), CAST(max(entry_ts) AS DATE)) + 1) AS tpd FROM trades GROUP BY symbol""")
def _(spark, sf):
    from barloom.operators.perf import trades_per_day
    from barloom.plans.bindings import trades
    return trades_per_day(trades(spark, sf), ["symbol"])


@query("daily_source", "symbol date:d open:r high:r low:r close:r", "SELECT * FROM daily")
def _(spark, sf):
    return daily(spark, sf)
