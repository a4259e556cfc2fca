"""Properties of fitted models and of walk-forward training."""
import datetime as dt
import inspect

import numpy as np
import pytest

from barloom.operators import evalml as E

D0 = dt.date(2020, 1, 1)
FEW = {"trees": 8, "depth": 3}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=600), rng.normal(size=600)
    r = a + 0.3 * rng.normal(size=600)
    data = [(k, D0 + dt.timedelta(days=k // 2), float(a[k]), float(b[k]), float(r[k]), int(r[k] > 0), 1.0 + k % 3) for k in range(600)]
    return spark.createDataFrame(data, "trade_id long, date date, a double, b double, r double, win int, w double").cache()


def fold(k, train, test):
    day = lambda n: D0 + dt.timedelta(days=n)
    return {"fold": k, "train_start": day(train[0]), "train_end": day(train[1]), "test_start": day(test[0]), "test_end": day(test[1])}


FOLDS = [fold(0, (0, 99), (110, 159)), fold(1, (0, 149), (160, 219)), fold(2, (0, 199), (298, 299)), fold(3, (0, 3), (5, 90))]


def test_walk_forward_reports_every_fold(spark, rows):
    out = E.walk_forward_fit(rows, FOLDS, ["a", "b"], "date", weight="w", penalty=1.5, **FEW)
    got = {r.fold: r for r in out.report.collect()}
    assert {k: r.status for k, r in got.items()} == {0: "fitted", 1: "fitted", 2: "skipped", 3: "skipped"}
    assert (got[0].n_train, got[0].n_test, got[0].n_all, got[2].n_test, got[3].n_train) == (200, 100, 100, 4, 8)
    assert got[2].threshold is None and got[2].n_all is None and all(0 < got[k].n_taken <= got[k].n_all for k in (0, 1))
    assert all(got[k].taken_expectancy > got[k].all_expectancy for k in (0, 1))
    pooled = out.pooled.select("fold", "trade_id", "pred", "threshold", "r", "a").toPandas()
    assert len(pooled) == 100 + 120 and not pooled["trade_id"].duplicated().any()
    assert pooled["pred"].rank().corr(pooled["a"].rank()) > 0.8
    assert (pooled[pooled["fold"] == 0]["pred"] >= got[0].threshold).sum() == got[0].n_taken
    assert out.threshold is not None and out.model.transform(rows).count() == 600


def test_walk_forward_without_a_fold_that_fits(spark, rows):
    out = E.walk_forward_fit(rows, FOLDS[2:], ["a", "b"], "date", **FEW)
    got = out.report.collect()
    assert [r.status for r in got] == ["skipped", "skipped"] and got[0].n_taken is None and (out.pooled, out.model, out.threshold) == (None, None, None)
    assert {"threshold", "n_all", "n_taken", "taken_sortino", "all_sortino"} <= set(out.report.columns)


def test_win_probability_rises_with_the_score(rows):
    model, calibration = E.fit_win_probability(rows, ["a", "b"], "win", weight="w", **FEW)
    p = E.win_probability(model, calibration, rows).select("a", "score", "p_win", "win").toPandas().sort_values("score")
    assert (p["p_win"].diff().dropna() >= -1e-12).all() and p["p_win"].between(0, 1).all()
    assert p["score"].rank().corr(p["a"].rank()) > 0.8 and abs(p["p_win"].mean() - p["win"].mean()) < 0.1


def test_full_counts_are_the_defaults():
    for f in (E.fit_regressor, E.fit_win_probability):
        d = inspect.signature(f).parameters
        assert (d["trees"].default, d["depth"].default) == (300, 4)


def test_importance_falls_on_what_drives_r(spark, rows):
    model = E.fit_regressor(rows, ["a", "b"], **FEW)
    top = E.top_features(E.feature_importance(model, ["a", "b"], spark)).collect()
    assert [t.feature for t in top] == ["a", "b"] and top[0].importance > 0.7
    best = E.best_execution(rows, model, [{"a": -2.0}, {"a": 2.0}, {"a": 2.0}], "trade_id")
    assert best.count() == 600 and best.where("cand <> 1").isEmpty()
