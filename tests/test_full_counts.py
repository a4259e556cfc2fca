"""Queries run at the reference's counts."""
import inspect

from pyspark.sql import functions as F

import __spark_entry__ as entry
from barloom.operators import regime


def test_block_bootstrap_equity_draws_two_thousand_paths(spark, sf):
    out = entry.queries()["block_bootstrap_equity"](spark, sf)
    assert {r.n for r in out.groupBy("symbol").count().withColumnRenamed("count", "n").collect()} == {2000}


def test_regimes_are_refitted_as_often_as_the_operator_does(spark, sf, monkeypatch):
    asked, signature = [], inspect.signature(regime.regime_labels)

    def labels(*args, **options):
        bound = signature.bind(*args, **options)
        bound.apply_defaults()
        asked.append((bound.arguments["refits"], bound.arguments["iterations"]))
        return args[0].select("symbol", "date", F.lit(1).alias("label"), F.lit(True).alias("in_sample"))

    monkeypatch.setattr(regime, "regime_labels", labels)
    for name in ("regime_labels", "vol_regime"):
        entry.queries()[name](spark, sf)
    assert len(asked) == 2 and all(refits >= 50 and iterations >= 100 for refits, iterations in asked)
