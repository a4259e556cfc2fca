"""Prices of zero, negative zeros and midpoints, where engines part."""
import math

from barloom.operators import perf as P
from barloom.operators import indicators as I
from barloom.functions import scalar as S
from barloom.operators import evalml as E
from pyspark.sql import functions as F
from tests.fixtures import t


def test_excursions_of_trades_entered_at_zero(spark):
    bars = spark.createDataFrame([("A", t("2024-01-02 10:00:00"), 4.0, 0.0)], "symbol string, ts timestamp_ntz, high double, low double")
    rows = [(k, "A", t("2024-01-02 09:00:00"), t("2024-01-02 11:00:00"), e, d) for k, e, d in ((1, 0.0, 1), (2, 0.0, -1), (3, 2.0, 1))]
    trades = spark.createDataFrame(rows, "trade_id int, symbol string, entry_ts timestamp_ntz, exit_ts timestamp_ntz, entry_price double, direction int")
    got = {r.trade_id: (r.mae, r.mfe) for r in P.mae_mfe(trades, bars, ["symbol"], "trade_id", "entry_ts", "exit_ts").collect()}
    assert math.isnan(got[1][0]) and got[1][1] == math.inf
    assert got[2][0] == math.inf and math.isnan(got[2][1])
    assert got[3] == (1.0, 1.0)


def test_returns_of_intervals_that_open_at_zero(spark):
    rows = [("A", t(f"2024-01-02 {at}:00"), float(o), float(c)) for at, o, c in (("09:30", 0, 2), ("10:00", 2, 3), ("11:00", 0, 0), ("12:30", 2, 3))]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, close double")
    got = [r.ret for r in I.interval_returns(bars, 90).orderBy("slot").collect()]
    assert got[0] == math.inf and math.isnan(got[1]) and got[2] == 0.5


def test_report_text_keeps_the_sign_of_what_rounds_to_zero(spark):
    df = spark.createDataFrame([(-0.0004,), (-0.0,), (0.0,), (0.0004,), (-0.125,), (None,)], "x double")
    got = [tuple(r) for r in df.select(S.fmt_pct("x"), S.fmt_number("x")).collect()]
    assert got == [("-0.0%", "-0.00"), ("-0.0%", "-0.00"), ("0.0%", "0.00"), ("0.0%", "0.00"), ("-12.5%", "-0.12"), *got[5:]]


def test_log_returns_from_and_to_zero(spark):
    df = spark.createDataFrame([(0.0, 2.0), (2.0, 0.0), (0.0, 0.0), (2.0, 2.0), (-1.0, 2.0), (None, 2.0)], "now double, before double")
    got = [r[0] for r in df.select(S.log_return("now", "before")).collect()]
    assert got[:2] == [-math.inf, math.inf] and math.isnan(got[2]) and got[3:] == [0.0, None, None]


def test_target_at_the_midpoint(spark):
    """12 points at a risk of about 7: 10 / risk and 14 / risk, each rounded, have a mean above 12 / risk for some risks."""
    risks = [(7.0 + k * 2.0**-50,) for k in range(64)]
    df = spark.createDataFrame(risks, "risk double")
    assert any((10 / x + 14 / x) / 2 > 12 / x for x, in risks)
    got = df.select(E.target_index(F.lit(12.0) / F.col("risk"), F.lit(10.0), F.lit(14.0), F.lit(2), F.col("risk"))).collect()
    assert {r[0] for r in got} == {1}
