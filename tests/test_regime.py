"""Refits side by side against one model at a time."""
import datetime as dt

import numpy as np
import pytest

from barloom.operators import regime as G


def densities(x, mean, var):
    return np.exp(-0.5 * (x[:, None] - mean) ** 2 / var) / np.sqrt(2 * np.pi * var) + 1e-300


def fit_one(x, k, iterations):
    """Baum-Welch of a single history, a loop a day."""
    edges = np.quantile(x, np.linspace(0, 1, k + 1))
    mean = np.array([x[(x >= a) & (x <= b)].mean() for a, b in zip(edges[:-1], edges[1:])])
    var, start = np.full(k, max(x.var(), 1e-8)), np.full(k, 1.0 / k)
    trans = np.full((k, k), 0.1 / max(k - 1, 1))
    np.fill_diagonal(trans, 0.9)
    n, last = len(x), -np.inf
    for _ in range(iterations):
        b = densities(x, mean, var)
        alpha, beta, scale = np.empty((n, k)), np.ones((n, k)), np.empty(n)
        for t in range(n):
            a = start * b[0] if t == 0 else (alpha[t - 1] @ trans) * b[t]
            scale[t] = a.sum()
            alpha[t] = a / scale[t]
        for t in range(n - 2, -1, -1):
            beta[t] = trans @ (b[t + 1] * beta[t + 1]) / scale[t + 1]
        gamma = alpha * beta
        gamma /= gamma.sum(axis=1, keepdims=True)
        pairs = np.zeros((k, k))
        for t in range(n - 1):
            pairs += trans * np.outer(alpha[t], b[t + 1] * beta[t + 1] / scale[t + 1])
        trans = pairs / pairs.sum(axis=1, keepdims=True)
        start, weight = gamma[0], gamma.sum(axis=0)
        mean = gamma.T @ x / weight
        var = np.maximum((gamma * (x[:, None] - mean) ** 2).sum(axis=0) / weight, 1e-8)
        ll = np.log(scale).sum()
        if ll - last < 1e-4:
            break
        last = ll
    o = np.argsort(mean)
    return start[o], trans[np.ix_(o, o)], mean[o], var[o]


def last_state(x, model):
    start, trans, mean, var = model
    b, lt = np.log(densities(x, mean, var)), np.log(trans + 1e-300)
    d = np.log(start + 1e-300) + b[0]
    for t in range(1, len(x)):
        d = (d[:, None] + lt).max(axis=0) + b[t]
    return int(d.argmax())


def series(n=150, seed=4):
    rng = np.random.default_rng(seed)
    state = np.repeat(rng.integers(0, 3, n // 10 + 1), 10)[:n]
    return rng.normal(np.array([-1.0, 0.0, 1.5])[state], np.array([0.6, 0.2, 0.4])[state])


@pytest.mark.parametrize("states", [2, 3])
def test_models_equal_single_fits(states):
    x, ends = series(), np.array([60, 61, 90, 150])
    m = G.fit_hmms(x, ends, states, 40)
    for r, end in enumerate(ends):
        for got, want in zip((m.start[r], m.trans[r], m.mean[r], m.var[r]), fit_one(x[:end], states, 40)):
            assert got == pytest.approx(want, rel=1e-6, abs=1e-9)


def test_labels_come_from_the_last_refit_before_the_day(spark):
    x = series(130)
    rows = [(s, dt.date(2024, 1, 1) + dt.timedelta(days=k), float(v)) for s, scale in (("A", 1.0), ("B", -2.0)) for k, v in enumerate(x * scale)]
    rows.append(("A", dt.date(2025, 1, 1), None))
    df = spark.createDataFrame(rows, "symbol string, date date, x double").repartition(3)
    got = {(r.symbol, r.date): r for r in G.regime_labels(df, ["symbol"], "x", refits=8, iterations=15).collect()}
    assert len(got) == 260
    for s, scale in (("A", 1.0), ("B", -2.0)):
        y, train, every = x * scale, 65, 8
        for k in range(130):
            r = got[s, dt.date(2024, 1, 1) + dt.timedelta(days=k)]
            assert r.in_sample == (k < train)
            if k >= train and k % 5 == 0:
                end = train + (k - train) // every * every
                assert r.label == last_state(y[:k + 1], fit_one(y[:end], 3, 15))
    # The past does not change when later days go.
    short = df.where("date < date'2024-04-20'")
    same = {(r.symbol, r.date): r.label for r in G.regime_labels(short, ["symbol"], "x", train_ratio=65 / 110, refits=5, iterations=15).where("NOT in_sample").collect()}
    assert same and all(got[k].label == v for k, v in same.items() if (k[1] - dt.date(2024, 1, 1)).days < 65 + 8)


def test_short_and_static_series(spark):
    rows = [("A", dt.date(2024, 1, 1) + dt.timedelta(days=k), 0.1 * k) for k in range(4)] + [("B", dt.date(2024, 1, 1), 1.0)]
    df = spark.createDataFrame(rows, "symbol string, date date, x double")
    assert G.regime_labels(df, ["symbol"], "x").count() == 5
    whole = G.regime_labels(df, ["symbol"], "x", mode="static").collect()
    assert len(whole) == 5 and all(r.in_sample for r in whole)
    assert G.regime_labels(df.limit(0), ["symbol"], "x").collect() == []
