from pyspark.sql import functions as F

from barloom.llm.common import beside, stored


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_decide_not_files(spark):
    """A stored table of 300,000 numbers is a small file; exploded from it, Spark takes it for smaller still."""
    small = stored(spark.range(300_000).select(F.floor(F.col("id") / 1000).alias("u"), F.lit(7).alias("v")))
    ids = small.select(F.explode(F.array("u", "v")).alias("line"))
    big = spark.range(10**7).withColumnRenamed("id", "line")
    assert "BroadcastHashJoin" in plan(ids.join(big, "line"))
    assert "Broadcast" not in plan(beside(ids, 600_000).join(big, "line")) and "BroadcastHashJoin" in plan(beside(ids, 60_000).join(big, "line"))
