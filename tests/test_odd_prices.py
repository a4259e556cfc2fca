"""filter_meta against its SQL on events without a price, with NaN and with infinite prices."""
import math
import random

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.fixtures import t


def test_filter_meta_equals_its_sql_on_odd_prices(spark, tmp_path):
    rng = random.Random(5)
    odd = [None, math.nan, math.inf, -math.inf]
    rows = [(k, k * 97, k % 7, "ab"[k % 2], rng.choice(odd) if rng.random() < 0.3 else round(rng.uniform(0, 60), 2)) for k in range(1500)]
    events = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double")
    start = F.lit(t("2024-01-02 00:00:05")).cast("timestamp_ntz")
    events.withColumn("ts", start + F.make_dt_interval(secs=F.col("s"))).drop("s").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = entry.queries()["filter_meta"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["filter_meta"]).fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert sum(math.isfinite(r.beyond) for r in got) > 50
