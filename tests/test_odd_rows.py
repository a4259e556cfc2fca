"""Queries over trades against their SQL: prices of either zero, below zero, infinite or NaN; events without a time or a user."""
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.fixtures import t

ODD = [None, math.nan, math.inf, -math.inf, 0.0, -0.0, -3.5, -0.125]


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    path, rng = str(tmp_path_factory.mktemp("odd")), random.Random(5)
    rows = [(k, None if rng.random() < 0.03 else k * 97, None if rng.random() < 0.05 else k % 7, "ab"[k % 2], rng.choice(ODD) if rng.random() < 0.4 else round(rng.uniform(0, 60), 2)) for k in range(2000)]
    events = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double")
    start = F.lit(t("2024-01-02 00:00:05")).cast("timestamp_ntz")
    events.withColumn("ts", start + F.make_dt_interval(secs=F.col("s"))).drop("s").coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("query", ["mae_mfe", "scalar_prices", "filter_meta"])
def test_equals_its_sql(spark, odd_dir, query):
    got = entry.queries()[query](spark, odd_dir).collect()
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{odd_dir}/events.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()[query]).fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
