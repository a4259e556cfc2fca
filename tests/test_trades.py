import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import rmetrics as R
from barloom.functions import trade as T
from barloom.operators import evalml as E
from barloom.operators import exits as X
from barloom.operators import perf as P
from barloom.operators import positions as PO
from barloom.operators.ledger import session_pnl_gate
from barloom.operators.perf import on_calendar
from tests.fixtures import t


def metrics(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "r double")
    return df.agg(*R.all_metrics(F.col("r"))).first()


def test_r_metrics_edges(spark):
    assert metrics(spark, [1.0] * 10).sortino == float("inf")
    assert metrics(spark, [-1.0] * 10).sortino == pytest.approx(-1.0)
    m = metrics(spark, [2, 2, 2, -1])
    assert (m.win_rate, m.expectancy, m.profit_factor) == (0.75, 1.25, 6.0)
    empty = metrics(spark, [])
    assert (empty.sortino, empty.expectancy, empty.win_rate, empty.profit_factor) == (0.0, 0.0, 0.0, 0.0)


def one_exit(spark, direction, sl, tp, bars):
    e = spark.createDataFrame([(1, "AAA", t("2024-01-02 09:30:00"), direction, sl, tp, t("2024-01-02 16:00:00"))], "entry_id int, symbol string, ts timestamp_ntz, direction int, sl_price double, tp_price double, end_ts timestamp_ntz")
    b = spark.createDataFrame([("AAA", t(f"2024-01-02 09:{31 + i}:00"), *map(float, x)) for i, x in enumerate(bars)], "symbol string, ts timestamp_ntz, open double, high double, low double, close double")
    r = X.first_touch_exit(e, b).first()
    return r.exit_reason, r.exit_price


@pytest.mark.parametrize("direction,sl,tp,bars,want", [
    (1, 18950.0, 19200.0, [(19000, 19100, 18900, 19050)], ("SL", 18950.0)),
    (1, 18800.0, 19080.0, [(19000, 19100, 18900, 19050)], ("TP", 19080.0)),
    (1, 18950.0, 19050.0, [(19000, 19100, 18900, 19050)], ("SL", 18950.0)),
    (1, 19010.0, 19200.0, [(19000, 19100, 18900, 19050)], ("SL", 19000.0)),
    (-1, 19050.0, 18800.0, [(19000, 19100, 18900, 19050)], ("SL", 19050.0)),
    (-1, 19200.0, 19010.0, [(19000, 19100, 18900, 19050)], ("TP", 19000.0)),
    (1, 18000.0, 20000.0, [(19000, 19100, 18900, 19050), (19050, 19060, 19040, 19055)], ("EOD", 19055.0)),
])
def test_exit_priority(spark, direction, sl, tp, bars, want):
    assert one_exit(spark, direction, sl, tp, bars) == want


def test_reverse_flips_result(spark):
    row = [(1, 100.0, 110.0, 1, 1.0, 0.0, 0.0, "TP", 95.0, 110.0, 95.0, 110.0, -1.0, 10.0)]
    df = spark.createDataFrame(row, "trade_id int, entry_price double, exit_price double, direction int, contracts double, slippage_points double, commission_per_contract double, exit_reason string, sl_price double, tp_price double, initial_sl_price double, initial_tp_price double, mae_points double, mfe_points double")
    a, b = T.with_trade_pnl(df).first(), T.with_trade_pnl(T.reverse_trades(df)).first()
    assert a.net_pnl_dollars == 200.0 and b.net_pnl_dollars == -200.0 and b.exit_reason == "SL" and a.r_multiple == 2.0


def test_drawdown(spark):
    df = spark.createDataFrame([("r", i, t("2024-01-02 10:00:00").replace(minute=i), float(x)) for i, x in enumerate([100, -50, -100, 30, 200, -10])], "run string, trade_id int, exit_ts timestamp_ntz, net double")
    eq = P.equity_curve(df, ["run"], ["exit_ts", "trade_id"], "net", 1000.0, F.floor(F.minute("exit_ts") / 2))
    s = P.drawdown_stats(eq, ["run"], ["exit_ts", "trade_id"], F.floor(F.minute("exit_ts") / 2)).first()
    assert s.max_dd == -150.0 and s.longest_rows == 3 and s.max_dd_pct == pytest.approx(-150 / 1100)
    k = P.streaks(df, ["run"], ["exit_ts", "trade_id"], "net", F.floor(F.minute("exit_ts") / 2)).first()
    assert (k.win_streak, k.loss_streak) == (2, 2)


def brute_greedy(rows):
    taken, until = [], -1
    for s in sorted({r[1] for r in rows}):
        best = max((r for r in rows if r[1] == s), key=lambda r: (r[3], -r[0]))
        if s > until:
            taken.append(best[0])
            until = best[2]
    return sorted(taken)


def test_greedy_selection_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(s), int(s + rng.integers(0, 12)), float(rng.random())) for i, s in enumerate(rng.integers(0, 300, 200))]
    df = spark.createDataFrame(rows, "id long, s long, e long, score double").withColumn("k", F.lit("x"))
    got = PO.greedy_non_overlap(df, ["k"], "s", "e", "score", "id")
    assert got.columns == ["k", "s", "id", "e", "score"] and sorted(r.id for r in got.collect()) == brute_greedy(rows)


def test_selection_over_many_blocks_and_thresholds(spark):
    """One chain over several blocks of a hot key, whatever the threshold: no trade depends on where a block ends."""
    rng = np.random.default_rng(6)
    start = rng.integers(0, 12_000, 15_000)
    rows = [("hot", i, int(s), int(s + rng.choice([0, 1, 3, 40, 3000], p=[0.3, 0.3, 0.2, 0.199, 0.001])), float(rng.random()), float(rng.normal())) for i, s in enumerate(start)]
    rows += [("few", 99_000 + i, 10 * i, 10 * i + 25, 0.5, 1.0) for i in range(9)]
    df = spark.createDataFrame(rows, "k string, id long, s long, e long, pred double, r double").repartition(3)
    assert df.select("k", "s").distinct().count() > 2 * PO.BLOCK
    levels = [0.0, 0.4, 0.9, 0.999]
    got = {(r.k, r.threshold): r for r in PO.threshold_sweep_selection(df, ["k"], levels, "s", "e", "id", p_high="pred", n_days=50).collect()}
    for k in ("hot", "few"):
        own = [x[1:] for x in rows if x[0] == k]
        r_of = {x[0]: x[4] for x in own}
        for level in levels:
            ids = brute_greedy([x for x in own if x[3] > level])
            r = got.get((k, level))
            if not ids:
                assert r is None
                continue
            assert (r.n, r.usable, r.n_high) == (len(ids), len(ids) >= 5, sum(1 for x in own if x[0] in set(ids) and x[3] > 0.5))
            assert (r.total_r, r.win_rate) == pytest.approx((sum(r_of[i] for i in ids), sum(r_of[i] > 0 for i in ids) / len(ids)))
            assert r.tpd == (max(0.1, len(ids) / 50) if len(ids) >= 5 else 0.0)
    assert sorted(r.id for r in PO.greedy_non_overlap(df, ["k"], "s", "e", "pred", "id").where("k = 'hot'").collect()) == brute_greedy([x[1:] for x in rows if x[0] == "hot"])


def test_search_threshold_prefers_profitable_tail(spark):
    df = spark.createDataFrame([(i / 100.0, 1.0 if i >= 50 else -1.0) for i in range(100)], "pred double, r double")
    best = E.search_threshold(df, [], "expectancy").first()
    assert best.expectancy == 1.0 and 0.49 < best.threshold < 0.55


def test_session_gate_knows_only_closed_trades(spark):
    rows = [("run", 1, t("2024-01-02 10:00:00"), t("2024-01-02 11:00:00"), 5.0), ("run", 2, t("2024-01-02 10:05:00"), t("2024-01-02 10:10:00"), -1.0), ("run", 3, t("2024-01-02 10:30:00"), t("2024-01-02 10:40:00"), 1.0),
            ("run", 4, t("2024-01-02 11:00:00"), t("2024-01-02 11:10:00"), 1.0)]
    df = spark.createDataFrame(rows, "run string, trade_id int, entry_ts timestamp_ntz, exit_ts timestamp_ntz, points double")
    allowed = lambda n, stop: [r.allowed for r in session_pnl_gate(df, ["run"], n, stop).orderBy("trade_id").collect()]
    assert allowed(9, True) == [True, True, True, False]
    assert allowed(2, True) == [True, True, False, False]
    assert allowed(9, False) == [True] * 4


def test_pnl_outside_the_calendar_moves_to_the_next_day(spark):
    d = lambda k: t(f"2024-01-{k:02d} 00:00:00").date()
    daily = spark.createDataFrame([("a", d(5), 1.0), ("a", d(6), 2.0), ("a", d(8), 4.0), ("a", d(10), 8.0)], "run string, date date, pnl double")
    calendar = spark.createDataFrame([(d(5),), (d(8),), (d(9),)], "date date")
    assert sorted(map(tuple, on_calendar(daily, calendar, ["run"]).collect())) == [("a", d(5), 1.0), ("a", d(8), 6.0), ("a", d(9), 8.0)]
