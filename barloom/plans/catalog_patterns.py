"""Queries over price patterns."""
from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import indicators as I
from barloom.operators import patterns as P
from barloom.operators.joins import level_match
from barloom.plans.bindings import bars, stored_bars
from barloom.plans.registry import cte, query

SYM = ["symbol"]


@query("candle_shape", "symbol ts body:r upper_wick:r lower_wick:r colour:i bull_pos:r bear_pos:r wick_ratio:r doji:b", """SELECT symbol, ts, abs(close - open) AS body, high - greatest(open, close) AS upper_wick, least(open, close) - low AS lower_wick, sign(close - open) AS colour,
    coalesce((close - open) / nullif(high - open, 0), 0) AS bull_pos, coalesce((open - close) / nullif(open - low, 0), 0) AS bear_pos, (high - greatest(open, close) + least(open, close) - low) / CASE WHEN high > low THEN high - low ELSE 0.01::DOUBLE END AS wick_ratio,
    abs(close - open) < 0.1::DOUBLE * (high - low) AS doji FROM bars""")
def _(spark, sf):
    return P.candle_shape(bars(spark, sf))


cte("piv", """SELECT *, n > 3 AND count(*) OVER (PARTITION BY symbol ORDER BY n ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) = 3 AS ok, max(high) OVER l AS lh, max(high) OVER r AS rh, min(low) OVER l AS ll, min(low) OVER r AS rl, lead(ts, 3) OVER (PARTITION BY symbol ORDER BY n) AS confirmed_ts
    FROM nbars WINDOW l AS (PARTITION BY symbol ORDER BY n ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY symbol ORDER BY n ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)""")
cte("swings", """SELECT symbol, ts, confirmed_ts, n, 'H' AS kind, high AS price FROM piv WHERE ok AND high > lh AND high > rh UNION ALL SELECT symbol, ts, confirmed_ts, n, 'L', low FROM piv WHERE ok AND low < ll AND low < rl""")


@query("swings", "symbol ts confirmed_ts kind:s price:r", "SELECT * FROM swings")
def _(spark, sf):
    return P.swings(bars(spark, sf), 3)


cte("lagged", "SELECT *, lag(open) OVER w AS po, lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl, lag(high, 2) OVER w AS h2, lag(low, 2) OVER w AS l2 FROM nbars WINDOW w AS (PARTITION BY symbol ORDER BY n)")
cte("fvg", "SELECT symbol, 'FVG' AS kind, ts, 1 AS direction, h2 AS near, low AS far FROM lagged WHERE h2 < low UNION ALL SELECT symbol, 'FVG', ts, -1, l2, high FROM lagged WHERE l2 > high")
cte("obs", """SELECT symbol, 'OB' AS kind, ts, 1 AS direction, greatest(po, pc) AS near, least(po, pc) AS far FROM lagged WHERE pc < po AND close > open AND close > ph
    UNION ALL SELECT symbol, 'OB', ts, -1, least(po, pc), greatest(po, pc) FROM lagged WHERE pc > po AND close < open AND close < pl""")
ZONE = "symbol kind:s ts direction:i near:r far:r"


@query("fvg_detect", ZONE, "SELECT * FROM fvg")
def _(spark, sf):
    return P.fvg_zones(bars(spark, sf))


@query("order_block_detect", ZONE, "SELECT * FROM obs")
def _(spark, sf):
    return P.order_block_zones(bars(spark, sf))


def _life_sql(source: str, kind2: str, edge1: str, edge2: str) -> str:
    one = f"SELECT z.*, ts AS origin_ts, (SELECT min(b.ts) FROM bars b WHERE b.symbol = z.symbol AND b.ts > z.ts AND ((z.direction = 1 AND b.close < z.{edge1}) OR (z.direction = -1 AND b.close > z.{edge1}))) AS ended_ts FROM {source} z"
    return f"""WITH a AS ({one}), f AS (SELECT symbol, '{kind2}' AS kind, ended_ts AS ts, -direction AS direction, near, far, ts AS origin_ts FROM a WHERE ended_ts IS NOT NULL)
    SELECT * FROM a UNION ALL SELECT f.*, (SELECT min(b.ts) FROM bars b WHERE b.symbol = f.symbol AND b.ts > f.ts AND ((f.direction = 1 AND b.close < f.{edge2}) OR (f.direction = -1 AND b.close > f.{edge2}))) AS ended_ts FROM f"""


@query("zone_lifecycle_ob", ZONE + " origin_ts ended_ts", _life_sql("obs", "BB", "far", "near"))
def _(spark, sf):
    b = stored_bars(spark, sf)
    return P.zone_lifecycle(P.order_block_zones(b), b)


cte("fvg_life", _life_sql("fvg", "IFVG", "near", "far"))


@query("zone_lifecycle_fvg", ZONE + " origin_ts ended_ts", "SELECT * FROM fvg_life")
def _(spark, sf):
    b = stored_bars(spark, sf)
    return P.zone_lifecycle(P.fvg_zones(b), b)


cte("rbs", """SELECT g.symbol, b.ts, g.ts AS gap_ts, g.direction, CASE WHEN g.direction = 1 THEN b.low ELSE b.high END AS wick_tip, CASE WHEN g.direction = 1 THEN least(b.open, b.close) ELSE greatest(b.open, b.close) END AS wick_base, abs(b.close - b.open) AS body
    FROM fvg_life g JOIN bars b ON g.kind = 'FVG' AND b.symbol = g.symbol AND b.ts > g.ts AND (g.ended_ts IS NULL OR b.ts < g.ended_ts)
    AND CASE WHEN g.direction = 1 THEN b.low ELSE b.high END BETWEEN least(near, far) AND greatest(near, far)""")


@query("rejection_zones", "symbol ts gap_ts direction:i wick_tip:r wick_base:r ended_ts", """SELECT r.*, (SELECT min(b.ts) FROM bars b WHERE b.symbol = r.symbol AND b.ts > r.ts AND ((r.direction = 1 AND b.low <= (wick_tip + wick_base) / 2) OR (r.direction = -1 AND b.high >= (wick_tip + wick_base) / 2))) AS ended_ts
    FROM rbs r WHERE body > 1e-9 AND abs(wick_base - wick_tip) > 0.5 * body""")
def _(spark, sf):
    b = stored_bars(spark, sf)
    gaps = P.zone_lifecycle(P.fvg_zones(b), b).where("kind = 'FVG'")
    return P.rejection_zones(gaps, b, 0.5)


cte("bos", """SELECT * FROM (SELECT s.*, (SELECT min(b.ts) FROM bars b WHERE b.symbol = s.symbol AND b.ts >= s.confirmed_ts AND ((s.kind = 'H' AND b.close > s.price) OR (s.kind = 'L' AND b.close < s.price))) AS bos_ts,
    (SELECT min(x.confirmed_ts) FROM swings x WHERE x.symbol = s.symbol AND x.kind = s.kind AND x.confirmed_ts > s.confirmed_ts AND ((s.kind = 'H' AND x.price > s.price) OR (s.kind = 'L' AND x.price < s.price))) AS replaced_ts FROM swings s)
    WHERE bos_ts IS NOT NULL AND (replaced_ts IS NULL OR bos_ts < replaced_ts)""")


@query("break_of_structure", "symbol kind:s ts price:r bos_ts", "SELECT * FROM bos")
def _(spark, sf):
    return P.break_of_structure(stored_bars(spark, sf), 3)


cte("runs0", """SELECT *, sum(nw) OVER (PARTITION BY symbol ORDER BY n) AS run FROM (SELECT *, (lag(colour) OVER w IS NULL OR lag(colour) OVER w <> colour OR lag(body) OVER w < 0.5 * body)::INT AS nw
    FROM (SELECT *, sign(close - open)::INT AS colour, abs(close - open) AS body FROM nbars) WINDOW w AS (PARTITION BY symbol ORDER BY n))""")
cte("cruns", "SELECT *, first_value(open) OVER (PARTITION BY symbol, run ORDER BY n) AS run_open, row_number() OVER (PARTITION BY symbol, run ORDER BY n) AS run_len FROM runs0")


@query("candle_runs", "symbol ts colour:i run:i run_open:r run_len:i", "SELECT * FROM cruns")
def _(spark, sf):
    return P.candle_runs(stored_bars(spark, sf), body_ratio=0.5)


cte("cisds", """SELECT * FROM (SELECT *, lag(run_open) OVER w AS cisd_level, CASE WHEN lag(colour) OVER w = -1 AND lag(run_len) OVER w >= 2 AND greatest(open, close) > lag(run_open) OVER w THEN 1
    WHEN lag(colour) OVER w = 1 AND lag(run_len) OVER w >= 2 AND least(open, close) < lag(run_open) OVER w THEN -1 ELSE 0 END AS cisd FROM cruns WINDOW w AS (PARTITION BY symbol ORDER BY n)) WHERE cisd <> 0""")


@query("cisd", "symbol ts cisd:i cisd_level:r", "SELECT * FROM cisds")
def _(spark, sf):
    return P.cisd(stored_bars(spark, sf), 2, 0.5)


cte("rc", """SELECT *, sum(nw) OVER (PARTITION BY symbol ORDER BY n) AS run FROM (SELECT *, (lag(colour) OVER w IS NULL OR lag(colour) OVER w <> colour)::INT AS nw FROM (SELECT *, sign(close - open)::INT AS colour FROM nbars) WINDOW w AS (PARTITION BY symbol ORDER BY n))""")
cte("afz", """SELECT symbol, ts, direction, CASE WHEN direction = 1 THEN edge ELSE tmax END AS zone_top, CASE WHEN direction = 1 THEN bmin ELSE -edge END AS zone_bot, CASE WHEN direction = 1 THEN lmin ELSE hmax END AS extreme, from_ts FROM (
    SELECT s.symbol, s.ts, s.direction, s.edge, s.p_ts AS from_ts, min(least(b.open, b.close)) AS bmin, max(greatest(b.open, b.close)) AS tmax, min(b.low) AS lmin, max(b.high) AS hmax FROM (
      SELECT symbol, ts, direction, arg_max(edge, [edge, p_n]) AS edge, arg_max(p_ts, [edge, p_n]) AS p_ts FROM (SELECT a.symbol, a.ts, a.colour AS direction, p.ts AS p_ts, p.n AS p_n, CASE WHEN a.colour = 1 THEN CASE WHEN a.close >= p.high THEN p.high ELSE p.open END ELSE -CASE WHEN a.close <= p.low THEN p.low ELSE p.open END END AS edge
        FROM rc a JOIN rc p ON p.symbol = a.symbol AND p.run = a.run - 1 AND p.colour = -a.colour AND a.colour <> 0 AND CASE WHEN a.colour = 1 THEN a.close >= p.open ELSE a.close <= p.open END) GROUP BY 1, 2, 3) s
    JOIN bars b ON b.symbol = s.symbol AND b.ts BETWEEN s.p_ts AND s.ts GROUP BY 1, 2, 3, 4, 5)""")
AFZ_SQL = """SELECT *, CASE WHEN direction = 1 THEN ceil((zone_top + zone_bot) / 2 / 0.25) * 0.25 ELSE floor((zone_top + zone_bot) / 2 / 0.25) * 0.25 END AS entry,
    CASE WHEN direction = 1 THEN floor((zone_bot - (zone_bot - extreme) / 2) / 0.25) * 0.25 ELSE ceil((zone_top + (extreme - zone_top) / 2) / 0.25) * 0.25 END AS sl FROM afz"""
cte("afz2", AFZ_SQL)


@query("afz", "symbol ts direction:i zone_top:r zone_bot:r extreme:r from_ts entry:r sl:r", "SELECT * FROM afz2")
def _(spark, sf):
    return P.afz(stored_bars(spark, sf))


cte("atrb", "SELECT b.*, a.x AS atr FROM nbars b JOIN atr_first a ON a.symbol = b.symbol AND a.n = b.n")
cte("flag0", "SELECT *, atr / close * 100 AS pct, (dir <> lag(dir) OVER (PARTITION BY symbol ORDER BY n))::INT AS flip FROM (SELECT *, sign(close - lag(close) OVER (PARTITION BY symbol ORDER BY n)) AS dir FROM atrb)")
cte("flags", """SELECT *, coalesce(n > 8 AND pct < 1.2::DOUBLE * ap AND (hi - lo) / greatest(close, 1e-9) < 20.0 * pow(atr / aa, 0.5::DOUBLE) AND CASE WHEN vp * 8 < 1e-10 THEN 0 ELSE r2 END < 0.6 AND fl >= 2, false) AS accum FROM (
    SELECT *, avg(pct) OVER f AS ap, avg(atr) OVER f AS aa, max(high) OVER f AS hi, min(low) OVER f AS lo, var_pop(close) OVER f AS vp, regr_r2(close, n) OVER f AS r2, sum(flip) OVER (PARTITION BY symbol ORDER BY n ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS fl
    FROM flag0 WINDOW f AS (PARTITION BY symbol ORDER BY n ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))""")
ACC = dict(lookback=8, atr_mult=1.2, band_pct=20.0, vol_sens=0.5, max_r2=0.6, min_flips=2)


def acc_flags(spark, sf):
    return P.accumulation_flags(I.atr(stored_bars(spark, sf), "seed_first"), **ACC)


@query("accumulation_flags", "symbol ts accum:b", "SELECT * FROM flags")
def _(spark, sf):
    return acc_flags(spark, sf)


cte("acczones", """SELECT symbol, min(n) - 8 AS start_pos, max(n) AS end_pos, max(ts) AS end_ts, max(hi) AS high, min(lo) AS low FROM (SELECT *, count(*) FILTER (NOT accum) OVER (PARTITION BY symbol ORDER BY n) AS g FROM flags) WHERE accum GROUP BY symbol, g HAVING max(n) + 1 - (min(n) - 8) >= 10""")


@query("accumulation_zones", "symbol start_pos:i end_pos:i end_ts high:r low:r", "SELECT * FROM acczones")
def _(spark, sf):
    return P.accumulation_zones(acc_flags(spark, sf), 8, 10)


@query("zone_overlap_merge", "symbol date:d start_pos:i end_pos:i high:r low:r", """WITH RECURSIVE z AS (SELECT symbol, CAST(end_ts AS DATE) AS date, start_pos AS s, end_pos AS e, high AS h, low AS l, row_number() OVER (PARTITION BY symbol, CAST(end_ts AS DATE) ORDER BY start_pos) AS k FROM acczones),
    w AS (SELECT symbol, date, k, 1 AS g, s, e, h, l FROM z WHERE k = 1 UNION ALL SELECT z.symbol, z.date, z.k, CASE WHEN m THEN w.g ELSE w.g + 1 END, CASE WHEN m THEN w.s ELSE z.s END, CASE WHEN m THEN greatest(w.e, z.e) ELSE z.e END, CASE WHEN m THEN greatest(w.h, z.h) ELSE z.h END, CASE WHEN m THEN least(w.l, z.l) ELSE z.l END
      FROM w JOIN (SELECT *, k - 1 AS pk FROM z) z ON z.symbol = w.symbol AND z.date = w.date AND z.pk = w.k, LATERAL (SELECT z.s - w.e <= 8 AND z.l <= w.h AND z.h >= w.l AS m) q)
    SELECT symbol, date, arg_max(s, k) AS start_pos, arg_max(e, k) AS end_pos, arg_max(h, k) AS high, arg_max(l, k) AS low FROM w GROUP BY symbol, date, g""")
def _(spark, sf):
    z = P.accumulation_zones(acc_flags(spark, sf), 8, 10).withColumn("date", F.to_date("end_ts"))
    return P.merge_overlapping_zones(z, 8)


cte("legs", """SELECT symbol, end_pos, kind, n AS pos, price, o_price, leg, CASE WHEN kind = 'H' THEN 1 ELSE -1 END AS direction FROM (SELECT *, row_number() OVER (PARTITION BY symbol, end_pos ORDER BY leg DESC, n) AS rn FROM (
    SELECT z.symbol, z.end_pos, s.kind, s.n, s.price, o.price AS o_price, abs(s.price - o.price) AS leg FROM acczones z JOIN swings s ON s.symbol = z.symbol AND s.n BETWEEN z.end_pos + 1 AND z.end_pos + 40
    JOIN LATERAL (SELECT price FROM swings x WHERE x.symbol = s.symbol AND x.kind <> s.kind AND x.n < s.n ORDER BY x.n DESC LIMIT 1 OFFSET 1) o ON true)) WHERE rn = 1""")


def legs(spark, sf):
    b = stored_bars(spark, sf)
    return P.manipulation_legs(P.accumulation_zones(acc_flags(spark, sf), 8, 10), P.swings(b, 3), 2, 40)


@query("swing_prior_lookup", "symbol end_pos:i kind:s pos:i price:r o_price:r leg:r direction:i", "SELECT * FROM legs")
def _(spark, sf):
    return legs(spark, sf)


@query("level_touched_since", "symbol ts kind:s price:r", """SELECT symbol, ts, kind, price FROM swings s WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.symbol = s.symbol AND b.ts > s.confirmed_ts AND b.ts <= s.confirmed_ts + INTERVAL 2 DAY AND b.low <= s.price AND b.high >= s.price)""")
def _(spark, sf):
    b = stored_bars(spark, sf)
    s = P.swings(b, 3).withColumn("until", F.col("confirmed_ts") + F.expr("INTERVAL 2 DAYS"))
    return P.untouched_levels(s, b, SYM, ["symbol", "ts", "kind"], "confirmed_ts", "until", "price")


@query("level_zone_match", "symbol ts kind:s price:r zone_ts level:r", """SELECT s.symbol, s.ts, s.kind, s.price, z.ts AS zone_ts, z.near AS level FROM swings s LEFT JOIN LATERAL (
    SELECT f.ts, f.near FROM fvg f WHERE f.symbol = s.symbol AND abs(f.near - s.price) <= 0.5 AND f.ts < s.ts AND f.direction = CASE WHEN s.kind = 'H' THEN -1 ELSE 1 END ORDER BY f.ts LIMIT 1) z ON true""")
def _(spark, sf):
    b = stored_bars(spark, sf)
    s = P.swings(b, 3).select("symbol", F.when(F.col("kind") == "H", -1).otherwise(1).alias("direction"), "kind", "ts", "price")
    z = P.fvg_zones(b).select("symbol", F.col("direction").cast("int").alias("direction"), F.col("ts").alias("zone_ts"), F.col("near").alias("level"))
    return level_match(s, z, [*SYM, "direction"], "price", "level", 0.5, "ts", "zone_ts", F.col("zone_ts"), ["zone_ts", "level"], ["symbol", "ts", "kind"])


@query("level_zone_live", "symbol ts kind:s price:r zone_ts level:r", """SELECT s.symbol, s.ts, s.kind, s.price, z.ts AS zone_ts, z.near AS level FROM swings s LEFT JOIN LATERAL (
    SELECT f.ts, f.near FROM fvg_life f WHERE f.kind = 'FVG' AND f.symbol = s.symbol AND abs(f.near - s.price) <= 0.5 AND f.ts < s.ts AND (f.ended_ts IS NULL OR s.ts <= f.ended_ts) AND f.direction = CASE WHEN s.kind = 'H' THEN -1 ELSE 1 END ORDER BY f.ts DESC LIMIT 1) z ON true""")
def _(spark, sf):
    """The latest gap still alive at each swing's price."""
    b = stored_bars(spark, sf)
    s = P.swings(b, 3).select("symbol", F.when(F.col("kind") == "H", -1).otherwise(1).alias("direction"), "kind", "ts", "price")
    z = P.zone_lifecycle(P.fvg_zones(b), b).where("kind = 'FVG'").select("symbol", F.col("direction").cast("int").alias("direction"), F.col("ts").alias("zone_ts"), F.col("near").alias("level"), "ended_ts")
    return level_match(s, z, [*SYM, "direction"], "price", "level", 0.5, "ts", "zone_ts", -F.unix_micros(F.col("zone_ts").cast("timestamp")), ["zone_ts", "level"], ["symbol", "ts", "kind"], "ended_ts")


@query("confluence_targets", "symbol ts target:r confluent:b", """WITH a AS (SELECT *, abs(entry - sl) AS risk, CASE WHEN direction = 1 THEN zone_top - extreme ELSE extreme - zone_bot END AS rng, CASE WHEN direction = 1 THEN zone_top ELSE zone_bot END AS base FROM afz2),
    t AS (SELECT a.*, base + direction * m * rng AS target FROM a, (VALUES (2.0::DOUBLE), (2.25), (2.5), (3.0), (3.25), (3.5), (4.0), (4.25), (4.5)) v(m) WHERE rng > 0 AND risk >= 1e-9 AND abs(base + direction * m * rng - entry) / risk >= 2)
    SELECT symbol, ts, target, EXISTS (SELECT 1 FROM swings s WHERE s.symbol = t.symbol AND CAST(s.ts AS DATE) = CAST(t.ts AS DATE) AND s.kind = CASE WHEN t.direction = 1 THEN 'L' ELSE 'H' END AND abs(s.price - t.target) <= 5) AS confluent FROM t""")
def _(spark, sf):
    b = stored_bars(spark, sf)
    return P.confluence_targets(P.afz(b).withColumn("date", F.to_date("ts")), P.pivots_by_day(P.swings(b, 3)), 2.0, 5.0)
