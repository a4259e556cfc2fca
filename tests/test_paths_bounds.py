import numpy as np
from pyspark.sql import functions as F

from barloom.operators import resample as R


def test_only_what_lies_outside_walks_on():
    """Of 20,000 values in a square of 65,536 some two thirds walk again, a few of them forty times."""
    sims, steps, n = np.arange(1000), np.arange(1000), 20_000
    walk, numbers = R.mixed, []
    try:
        R.mixed = lambda h: (numbers.append(h.size), walk(h))[1]
        R.shuffled(7, sims, steps, n)
    finally:
        R.mixed = walk
    assert sum(numbers) < 4 * 5 * sims.size * steps.size


def test_segments_are_few(spark):
    """A key's values are sent once a segment: 20,000 of them at 2,000 simulations to three, not to twenty."""
    blocks = R.value_blocks(spark.range(20_000).select(F.lit("A").alias("k"), F.col("id").alias("i"), (F.col("id") % 7 - 3).cast("double").alias("x")), ["k"], ["i"], "x", block=F.floor(F.col("i") / 4096))
    totals = R.simulated_paths(blocks, ["k"], 2000, 1000.0).totals
    assert totals.select("seg").distinct().count() == 3


def test_orders_of_few_values_come_up_evenly():
    """Each of the 120 orders of five values some 500 times."""
    count = np.unique(R.shuffled(77, np.arange(60_000), np.arange(5), 5), axis=0, return_counts=True)[1]
    assert len(count) == 120 and abs(count - 500).max() < 5 * np.sqrt(500)


def test_values_are_not_shuffled_to_segments(spark):
    """Tasks read the values from the shared folder: no plan of paths carries them through an exchange, once or per segment."""
    blocks = R.value_blocks(spark.range(9000).select(F.lit("A").alias("k"), F.col("id").alias("i"), (F.col("id") % 7 - 3).cast("double").alias("x")), ["k"], ["i"], "x", block=F.floor(F.col("i") / 4096))
    paths = R.simulated_paths(blocks, ["k"], 60, 1000.0, steps=500)
    rows = paths._segments().count(), paths._segments().columns
    assert rows == (18, ["k", "code", "n", "mark", "seg"])
    assert paths.summary().count() == 60 and paths.fan().count() == 9000
