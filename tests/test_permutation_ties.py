import datetime as dt

import numpy as np

from barloom.operators import resample as RS


def test_all_days_allowed_is_certain(spark):
    """Every permutation then trades the same days: the gain is 0, whatever order its sums are taken in."""
    x = np.random.default_rng(7).normal(0.1, 1, (12, 400))
    days = [dt.date(2020, 1, 1) + dt.timedelta(k) for k in range(400)]
    trades = spark.createDataFrame([(g, d, float(v)) for g in range(12) for d, v in zip(days, x[g])], "g int, date date, x double")
    labels = spark.createDataFrame([(d, 1) for d in days], "date date, label int")
    got = RS.permutation_test(trades, labels, ["g"], [1, 2], 300).collect()
    assert {r.p_value for r in got} == {1.0} and max(abs(r.mean_gain) for r in got) < 1e-9
