"""Resampling against numpy: every draw listed, every path walked."""
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from barloom.operators import resample as R
from barloom.plans import catalog_stats

DAY = dt.datetime(2024, 1, 1)


def frame(spark, sizes, seed=1):
    rng = np.random.default_rng(seed)
    values = {k: rng.normal(1.0, 50.0, n).round(3) for k, n in sizes.items()}
    rows = [(k, i, DAY + dt.timedelta(minutes=5 * i), float(x)) for k, v in values.items() for i, x in enumerate(v)]
    rows.append(("A", 10**6, DAY, None))
    return values, spark.createDataFrame(rows, "symbol string, id long, ts timestamp, x double").repartition(3)


def blocks_of(df):
    return R.value_blocks(df, ["symbol"], ["ts", "id"], "x")


def code_of(blocks, symbol):
    return blocks.where(F.col("symbol") == symbol).first().code


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 1000])
def test_shuffles_are_orders(n):
    got = R.shuffled(12345678901234, np.arange(40), np.arange(n), n)
    assert (np.sort(got, axis=1) == np.arange(n)).all()
    if n > 16:
        assert len({tuple(r) for r in got}) == 40 and abs(got[:, 0].mean() - (n - 1) / 2) < n * 0.25
    # A stretch of steps alone gives the same places.
    assert (R.shuffled(12345678901234, np.arange(40), np.arange(n // 2, n), n) == got[:, n // 2:]).all()


def test_draws_are_even():
    got = R.with_replacement(987654321, np.arange(300), np.arange(1000), 50)
    count = np.bincount(got.ravel(), minlength=50)
    assert got.min() == 0 and got.max() == 49 and abs(count - 6000).max() < 6 * np.sqrt(6000)
    assert abs(np.corrcoef(got[0], got[1])[0, 1]) < 0.15 and abs(np.corrcoef(got[0, 1:], got[0, :-1])[0, 1]) < 0.15


@pytest.mark.parametrize("how", ["bootstrap", "shuffle"])
@pytest.mark.parametrize("steps", [7, 64, None])
def test_paths_against_a_walk(spark, how, steps):
    values, df = frame(spark, {"A": 301, "B": 12, "C": 1})
    blocks = blocks_of(df)
    paths = R.simulated_paths(blocks, ["symbol"], 40, 1000.0, how, steps)
    got = {(r.symbol, r.sim): r for r in paths.summary().collect()}
    fans = {(r.symbol, r.draw): r for r in paths.fan().collect()}
    assert len(got) == 120 and len(fans) == 314
    for k, v in values.items():
        place = R.DRAWS[how](code_of(blocks, k), np.arange(40), np.arange(len(v)), len(v))
        equity = 1000.0 + np.cumsum(v[place], axis=1)
        for sim in range(40):
            x, peak, worst = v[place[sim]], 1000.0, np.inf
            for e in equity[sim]:
                peak = max(peak, e)
                worst = min(worst, (e - peak) / peak)
            r = got[k, sim]
            losses = -x[x < 0].sum()
            assert (r.final_equity, r.max_dd_pct, r.mean, r.win_rate) == pytest.approx((equity[sim, -1], worst, x.mean(), (x > 0).mean()))
            assert r.profit_factor == (pytest.approx(x[x > 0].sum() / losses) if losses else None)
        for d in range(len(v)):
            e = np.sort(equity[:, d])
            assert [fans[k, d + 1][f"p{p}"] for p in (5, 25, 50, 75, 95)] == pytest.approx([e[round(p / 100 * 39)] for p in (5, 25, 50, 75, 95)])


def test_numbers_of_draws_per_block():
    n = 5 * R.BLOCK + 100
    counts = np.stack([R.draws_in_block(77, n, b, 500) for b in range(6)])
    assert (counts.sum(axis=0) == n).all() and (counts >= 0).all()
    p = np.array([R.BLOCK] * 5 + [100]) / n
    assert (abs(counts.mean(axis=1) - n * p) < 5 * np.sqrt(n * p * (1 - p) / 500)).all()
    assert (abs(counts.var(axis=1) / (n * p * (1 - p)) - 1) < 0.35).all()


def test_sums_of_a_block_against_its_draws():
    rng = np.random.default_rng(2)
    xs, count = rng.normal(size=50), np.array([0, 7, 50, 1, 0, 300])
    draws = np.split(xs[np.random.Generator(np.random.Philox(key=[5 ^ 0x5DEECE66D, 3])).integers(0, 50, count.sum())], np.cumsum(count)[:-1])
    want = [[d.sum(), (d * d).sum(), (d > 0).sum(), d[d > 0].sum(), d[d < 0].sum()] for d in draws]
    assert R.block_sums(xs, count, 5, 3).T == pytest.approx(np.array(want, float))


def test_bootstrap_sums_follow_the_sample(spark):
    values, df = frame(spark, {"A": 9500, "B": 30})
    blocks = blocks_of(df)
    assert blocks.where("symbol = 'A'").count() == 3
    rows = R.bootstrap_sums(blocks, ["symbol"], 400).toPandas()
    again = R.bootstrap_sums(blocks.repartition(7), ["symbol"], 400).toPandas()
    order = ["symbol", "sim"]
    a, b = (x.sort_values(order).reset_index(drop=True)[["mean", "sd", "win_rate"]].to_numpy() for x in (rows, again))
    assert np.allclose(a, b) and len(rows) == 800
    for k, v in values.items():
        r = rows[rows["symbol"] == k]
        spread = v.std() / np.sqrt(len(v))
        assert abs(r["mean"].mean() - v.mean()) < 5 * spread / 20 and abs(r["mean"].std() / spread - 1) < 0.2
        assert abs(r["win_rate"].mean() - (v > 0).mean()) < 0.02 and abs(r["sd"].mean() / v.std() - 1) < 0.05


def test_permuted_gains_one_by_one():
    rng = np.random.default_rng(3)
    days, ok = np.stack([rng.integers(1, 5, 60).astype(float), rng.normal(size=60), 1 + rng.random(60)], axis=1), rng.random(60) < 0.4

    def sharpe(d):
        n, s, q = d.sum(axis=0)
        sd = np.sqrt(q / n - (s / n) ** 2)
        return s / n / sd * np.sqrt(252)

    got = R.permuted_gains(days, ok, np.arange(30), 999)
    bits = R.hashed(999, np.arange(30), np.arange(60))
    for p in range(30):
        order = sorted(range(60), key=lambda k: (bits[p, k], k))
        kept = days[np.array([ok[order[k]] for k in range(60)])]
        assert got[p] == pytest.approx(sharpe(kept) - sharpe(days))


def test_blocks_of_days(spark):
    df = spark.createDataFrame([("A", DAY + dt.timedelta(days=k)) for k in range(57)] + [("B", DAY)], "symbol string, date timestamp")
    rows = R.block_bootstrap(df, ["symbol"], "date", 200, 5.0).toPandas().sort_values(["symbol", "sim", "step"])
    assert len(rows) == 200 * 58 and (rows[rows["symbol"] == "B"]["pos"] == 0).all()
    a = rows[rows["symbol"] == "A"]
    pos, at = (a[c].to_numpy().reshape(200, 57) for c in ("pos", "block_start"))
    assert (at[:, 0] == 0).all() and (at <= np.arange(57)).all()
    on = at[:, 1:] == at[:, :-1]
    assert (pos[:, 1:][on] == (pos[:, :-1][on] + 1) % 57).all() and (at[:, 1:][~on] == np.broadcast_to(np.arange(1, 57), (200, 56))[~on]).all()
    assert abs((~on).mean() - 0.2) < 0.02 and set(pos.ravel()) == set(range(57))


def test_registered_at_full_counts(spark, sf):
    assert (catalog_stats.SIMS, catalog_stats.PERMS) == (2000, 5000)
    assert {r.n for r in entry.queries()["bootstrap_trades"](spark, sf).groupBy("symbol").agg(F.count("*").alias("n")).collect()} == {2000}


def test_intervals_leave_out_undefined_simulations(spark):
    rows = [("A", k, float(k), None if k else 2.0, float("nan") if k % 2 else float(k)) for k in range(101)] + [("B", k, None, None, None) for k in range(3)]
    sims = spark.createDataFrame(rows, "symbol string, sim long, mean double, profit_factor double, sharpe double")
    got = {r.symbol: r for r in R.confidence_intervals(sims, ["symbol"], ["mean", "profit_factor", "sharpe"]).collect()}
    assert (got["A"].mean_lo, got["A"].mean_hi, got["A"].sharpe_lo, got["A"].sharpe_hi) == pytest.approx((2.5, 97.5, 2.5, 97.5))
    assert (got["A"].profit_factor_lo, got["A"].profit_factor_hi) == (0.0, 0.0) and set(got["B"][1:]) == {0.0}


def test_moments_against_the_draws(spark):
    values, df = frame(spark, {"A": 301, "B": 12})
    df = df.union(spark.createDataFrame([("C", i, DAY + dt.timedelta(minutes=i), 0.1) for i in range(40)], df.schema))
    blocks = blocks_of(df)
    got = {(r.symbol, r.sim): r for r in R.simulated_paths(blocks, ["symbol"], 40, 0.0, steps=64).moments().collect()}
    for k, v in values.items():
        x = v[R.with_replacement(code_of(blocks, k), np.arange(40), np.arange(len(v)), len(v))]
        assert [got[k, s].mean for s in range(40)] == pytest.approx(x.mean(axis=1)) and [got[k, s].sd for s in range(40)] == pytest.approx(x.std(axis=1))
    assert {got["C", s].sd for s in range(40)} == {0.0}


def test_intervals_hold_the_sharpe_of_all_trading_days(spark, sf):
    assert {"sharpe_lo", "sharpe_hi"} <= set(entry.queries()["bootstrap_ci"](spark, sf).columns)
    assert catalog_stats.sharpes(spark, sf).groupBy("symbol").agg(F.count("sharpe").alias("n")).where("n < 1900").isEmpty()
