"""Boosted trees against those of pyspark.ml, and the jobs they share."""
import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from barloom.operators import boosting as B
from barloom.operators import evalml as E

X = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    a, b, c = rng.normal(size=900), rng.integers(0, 7, 900), rng.normal(size=900)
    r = a * b + np.sin(3 * c) + 0.3 * rng.normal(size=900)
    data = [(k, float(a[k]), float(b[k]), float(c[k]), float(r[k]), int(r[k] > 0), 1.0 + k % 3) for k in range(900)]
    return spark.createDataFrame(data, "trade_id long, a double, b double, c double, r double, win int, w double").cache()


def wide(d):
    return VectorAssembler(inputCols=X, outputCol="features").transform(d)


@pytest.mark.parametrize("tasks", [1, 3])
def test_regressor_is_that_of_pyspark(rows, monkeypatch, tasks):
    monkeypatch.setattr(B, "TASK_ROWS", 900 // tasks)
    want = GBTRegressor(labelCol="r", weightCol="w", predictionCol="want", maxIter=12, maxDepth=4, stepSize=0.05, minInstancesPerNode=10).fit(wide(rows))
    got = B.fit_trees(rows, X, "r", "w", 12, 4, 0.05, 1.0, 10, 42)[0]
    p = got.transform(want.transform(wide(rows))).select("pred", "want").toPandas()
    assert p["pred"].to_numpy() == pytest.approx(p["want"].to_numpy(), abs=1e-9)
    assert got.importances == pytest.approx(want.featureImportances.toArray(), abs=1e-9)


def test_classifier_is_that_of_pyspark(rows):
    want = GBTClassifier(labelCol="win", weightCol="w", maxIter=12, maxDepth=4, stepSize=0.05).fit(wide(rows))
    got = B.fit_trees(rows, X, "win", "w", 12, 4, 0.05, 1.0, 1, 42, classify=True)[0]
    p = want.transform(wide(rows)).select(vector_to_array("probability")[1].alias("want"), got.probability().alias("p")).toPandas()
    assert p["p"].to_numpy() == pytest.approx(p["want"].to_numpy(), abs=1e-9)


def test_models_grow_in_the_same_jobs(spark, rows):
    """F4, F5, F8: each fold's model was a series of jobs of its own."""
    sc = spark.sparkContext
    sc.setJobGroup("four fits", "")
    E.fit_win_probability(rows, X, "win", trees=10)
    sc.setJobGroup("others", "")
    assert len(sc.statusTracker().getJobIdsForGroup("four fits")) <= 10 * 4 + 20


def test_models_side_by_side_are_those_fitted_alone(rows):
    parts = [F.col("trade_id") % 3 != 0, F.col("trade_id") < 400]
    for got, part in zip(E.fit_regressors(rows, parts, X, trees=5), parts):
        alone = E.fit_regressor(rows.where(part), X, trees=5)
        assert np.array_equal(got.feature, alone.feature) and got.value == pytest.approx(alone.value, abs=1e-9)


def test_rows_are_drawn_by_their_values(rows):
    """The order and the number of the partitions do not matter to which rows a tree sees."""
    one, other = (E.fit_regressor(d, X, trees=5) for d in (rows, rows.orderBy("c").repartition(7)))
    assert np.array_equal(one.feature, other.feature) and one.value == pytest.approx(other.value, abs=1e-9)
    h = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 20_000)
    assert abs(B._drawn(h, 42, 3, 0.8).mean() - 0.8) < 0.02 and (B._drawn(h, 42, 3, 0.8) != B._drawn(h, 42, 4, 0.8)).any()


def test_missing_values_go_right_and_labels_must_be_there(spark):
    d = spark.createDataFrame([(None if k % 2 else float(k), 1.0 if k % 2 else 0.0) for k in range(80)], "a double, r double")
    p = E.fit_regressor(d, ["a"], trees=3, depth=2).transform(d).toPandas()
    assert p[p.a.isna()]["pred"].mean() > p[~p.a.isna()]["pred"].mean() + 0.3
    with pytest.raises(ValueError):
        E.fit_regressor(spark.createDataFrame([(1.0, None)], "a double, r double"), ["a"])
