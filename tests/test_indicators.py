import numpy as np
import pandas as pd
import pytest

from barloom.operators import indicators as I
from tests.fixtures import walk


def true_range(p):
    pc = p.close.shift(1)
    return pd.concat([p.high - p.low, (p.high - pc).abs(), (p.low - pc).abs()], axis=1).max(axis=1).to_numpy()


def test_wilder_atr_from_mean_seed(spark):
    p, df = walk(spark, 2500)
    tr = true_range(p)
    want = np.zeros(2500)
    want[13] = tr[:14].mean()
    for i in range(14, 2500):
        want[i] = want[i - 1] * 13 / 14 + tr[i] / 14
    got = I.atr(df, "seed_mean_tr").orderBy("ts").toPandas()["atr"]
    assert np.allclose(got, want, rtol=1e-9)


def test_rsi(spark):
    p, df = walk(spark, 400)
    d = np.diff(p.close)
    g, s, want = np.maximum(d, 0), np.maximum(-d, 0), np.full(400, 50.0)
    ag, al = g[:14].mean(), s[:14].mean()
    for i in range(14, 399):
        ag, al = (ag * 13 + g[i]) / 14, (al * 13 + s[i]) / 14
        want[i + 1] = 100 - 100 / (1 + ag / al)
    assert np.allclose(I.rsi(df).orderBy("ts").toPandas()["rsi"], want)


def test_parabolic_sar_bounds_price(spark):
    p, df = walk(spark, 300)
    got = I.parabolic_sar(df).orderBy("ts").toPandas()
    body = got.iloc[2:]
    up = body.trend == 1
    flips = body.trend != got.trend.shift(1).iloc[2:]
    assert (body.psar[up & ~flips] <= body.low[up & ~flips] + 1e-9).all() and (body.psar[~up & ~flips] >= body.high[~up & ~flips] - 1e-9).all()


@pytest.mark.parametrize("variant", ["seed_first", "ewm", "seed_mean_range", "zero_state", "truncated", "rolling", "mean_change"])
def test_variants_are_finite(spark, variant):
    _, df = walk(spark, 120)
    got = I.atr(df, variant).toPandas()["atr"].dropna()
    assert len(got) >= 100 and np.isfinite(got).all()
