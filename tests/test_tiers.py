"""First crossings through tiers of extremes against a plain search."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barloom.operators.joins import spread_join
from barloom.operators.tiers import tiers

DAY = dt.datetime(2024, 1, 1)


def series(spark, per_day, days, seed=1, symbols=("A", "B")):
    rng, rows = random.Random(seed), []
    for s in symbols:
        price = 100.0
        for d in range(days):
            for k in range(per_day):
                price += rng.choice([-1, -0.5, 0, 0.5, 1])
                rows.append((s, DAY + dt.timedelta(days=d, minutes=k), price + rng.random(), price - rng.random(), price))
    return rows, spark.createDataFrame(rows, "symbol string, ts timestamp, high double, low double, close double")


def levels(spark, rows, seed=2, n=120):
    rng, out = random.Random(seed), []
    for k in range(n):
        s, ts, _, _, c = rng.choice(rows)
        up, down = (c + rng.choice([1, 4, 15, 300]) if rng.random() < 0.8 else None), (c - rng.choice([1, 4, 15]) if rng.random() < 0.5 else None)
        out.append((k, s, ts + dt.timedelta(seconds=rng.choice([0, 0, 30, -30])), up, down))
    # Many levels that one bar ends, levels before the first bar, after the last, and of a symbol without bars.
    out += [(1000 + k, "A", rows[3][1], 101.5, None) for k in range(200)]
    out += [(2000, "A", DAY - dt.timedelta(days=9), 101.0, 99.0), (2001, "A", DAY + dt.timedelta(days=900), 0.0, None), (2002, "Z", DAY, 1.0, None), (2003, "B", None, 1.0, None)]
    return out, spark.createDataFrame(out, "id long, symbol string, after timestamp, upper double, lower double")


def plain(rows, wanted, strict, from_here):
    out = {}
    for k, s, after, up, down in wanted:
        hits = [
            ts for x, ts, h, l, _ in rows
            if x == s and after is not None and (ts >= after if from_here else ts > after)
            and (up is not None and (h > up if strict else h >= up) or down is not None and (l < down if strict else l <= down))]
        out[k] = min(hits, default=None)
    return out


@pytest.mark.parametrize("fan_out", [3, 128])
@pytest.mark.parametrize("strict,from_here", [(True, False), (False, True)])
def test_first_bar_beyond(spark, fan_out, strict, from_here):
    rows, bars = series(spark, 60, 4)
    wanted, table = levels(spark, rows)
    index = tiers(bars, payload=["close"], fan_out=fan_out)
    assert index.fan_out ** index.depth >= 240 and (fan_out > 3 or index.depth == 5)
    got = index.first(table, "after", F.col("upper"), F.col("lower"), strict, from_here).collect()
    want = plain(rows, wanted, strict, from_here)
    assert len(got) == len(wanted) and {r.id: r.hit_ts for r in got} == want
    close = {(s, ts): c for s, ts, _, _, c in rows}
    assert all(r.hit.close == close[r.symbol, r.hit_ts] for r in got if r.hit_ts)
    assert sum(t is not None for t in want.values()) > 200


def test_reads_do_not_grow_with_bars_a_day(spark):
    """Rows that a level is joined with: the blocks it starts in (one row), and one a tier on the way down."""
    for per_day in (20, 200, 1000):
        rows, bars = series(spark, per_day, 3, symbols=("A",))
        _, table = levels(spark, rows)
        index = tiers(bars, fan_out=8)
        at = index.start_of(table, "after").withColumnRenamed("__blk", "block")
        assert at.count() == table.count()
        assert at.join(index.paths(), ["symbol", "block"]).count() <= table.count()
        for t in range(1, index.depth + 1):
            assert index.tier(t).groupBy("symbol", "block").count().where("count > 1").isEmpty()
            assert index.tier(t).where(F.size("his") > 8).isEmpty()


def test_no_bars_and_no_levels(spark):
    rows, bars = series(spark, 5, 1)
    _, table = levels(spark, rows)
    assert tiers(bars.limit(0)).first(table, "after", F.col("upper")).where("hit_ts IS NOT NULL").isEmpty()
    assert tiers(bars).first(table.limit(0), "after", F.col("upper")).isEmpty()


def test_spread_join_splits_crowded_keys(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("k"), "id")
    right = spark.range(-1, 3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = spread_join(left, right, ["k"], 3000)
    assert got.columns == ["k", "id", "v"]
    assert got.count() == 3000 and got.where("v <> 2 * k").isEmpty() and got.select("id").distinct().count() == 3000
