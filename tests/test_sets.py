"""Fingerprints of trade sets."""
import hashlib

from pyspark.sql import functions as F

from barloom.operators import sets as U


def test_digest_of_ranges(spark):
    rows = [("A", k, f"r{k % 7}") for k in range(1, 24)] + [("B", 5, "x")]
    df = spark.createDataFrame(rows, "run string, id long, v string").repartition(3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for size in (1, 5, 23, 100):
        got = {r.run: r for r in U.ordered_digest(df.withColumn("h", F.sha2("v", 256)), ["run"], "h", "id", F.floor(F.col("id") / 4), size).collect()}
        for run in "AB":
            h = [sha(v) for r, _, v in rows if r == run]
            assert (got[run].n, got[run].digest) == (len(h), sha("".join(sha("".join(h[i:i + size])) for i in range(0, len(h), size))))
    moved = df.withColumn("id", F.when(F.col("id") == 1, 24).otherwise(F.col("id")))
    assert U.fingerprint(df, ["run"], ["v"]).exceptAll(U.fingerprint(moved, ["run"], ["v"])).isEmpty()
    assert not U.fingerprint(df, ["run"], ["id", "v"]).exceptAll(U.fingerprint(moved, ["run"], ["id", "v"])).isEmpty()
