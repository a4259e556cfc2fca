"""Levels that live at a price and a time, against all pairs."""
import datetime as dt
import random

from pyspark.sql import functions as F

from barloom.operators.joins import level_match, live_levels

T0 = dt.datetime(2020, 2, 28, 22, 30)


def tables(spark, seed=1):
    rng = random.Random(seed)
    hour = lambda h: T0 + dt.timedelta(minutes=int(h * 60))
    levels = []
    for k in range(300):
        a = rng.uniform(0, 9000)
        life = rng.choice([0, 0.3, 2, 17, 300, 5000, None])
        levels.append((rng.choice("AB"), k, round(rng.uniform(90, 110), 2), hour(a), None if life is None else hour(a + life)))
    prices = [(rng.choice("ABZ"), k, round(rng.uniform(90, 110), 2), hour(rng.uniform(-10, 9500))) for k in range(400)]
    prices += [(s, 1000 + k, p, t) for s, k, p, t, _ in levels[:20]] + [(s, 2000 + k, p + 0.5, e) for s, k, p, _, e in levels[:60] if e]
    return prices, levels, spark.createDataFrame(prices, "symbol string, id long, price double, ts timestamp"), spark.createDataFrame(levels, "symbol string, level_id long, level double, zone_ts timestamp, ended_ts timestamp")


def test_first_live_level(spark):
    prices, levels, p, l = tables(spark)
    got = {r.id: r.level_id for r in level_match(p, l, ["symbol"], "price", "level", 0.5, "ts", "zone_ts", F.col("level_id"), ["level_id"], ["id"], "ended_ts").collect()}
    want = {i: min((k for s2, k, x, a, e in levels if s2 == s and abs(x - c) <= 0.5 and a < t and (e is None or t <= e)), default=None) for s, i, c, t in prices}
    assert got == want and sum(v is not None for v in want.values()) > 100
    got = {r.id: r.level_id for r in level_match(p, l, ["symbol"], "price", "level", 0.5, "ts", "zone_ts", F.col("level_id"), ["level_id"], ["id"]).collect()}
    assert got == {i: min((k for s2, k, x, a, _ in levels if s2 == s and abs(x - c) <= 0.5 and a < t), default=None) for s, i, c, t in prices}


def test_pairs_are_bounded_by_live_levels(spark):
    """Each pair meets once, and only pairs whose level lives within the hour, three buckets of ``tol`` around the price."""
    prices, levels, p, l = tables(spark, 2)
    pairs = [(r.id, r.level_id) for r in live_levels(p, l, ["symbol"], "price", "level", 0.5, "ts", "zone_ts", "ended_ts").collect()]
    near, h = {}, dt.timedelta(hours=1)
    for s, i, c, t in prices:
        for s2, k, x, a, e in levels:
            near[i, k] = s == s2 and abs(x - c) < 1.0 and a - h < t and (e is None or t < e + h)
    assert len(pairs) == len(set(pairs)) and all(near[x] for x in pairs)
    dead = sum(1 for s, _, c, t in prices for s2, _, x, _, e in levels if s == s2 and abs(x - c) < 1.0 and e is not None and e < t)
    assert len(pairs) < 0.7 * (len(pairs) + dead)
