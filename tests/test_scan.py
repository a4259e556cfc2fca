import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators.scan import affine, dealt_by_value, decay_chunk, decay_halo, exact_quantiles, framed, medians, ordered_walk, prefix, with_ordinal
from tests.fixtures import walk


@pytest.mark.parametrize("chunk", [7, 64, 4096])
def test_framed_is_exact_for_any_chunk(spark, chunk):
    pdf, df = walk(spark, 300)
    got = framed(df, ["symbol"], ["ts"], lambda d, w: d.withColumn("m", F.avg("close").over(w.rowsBetween(-9, 0))).withColumn("nxt", F.lead("close", 2).over(w)), before=9, after=2, block=F.date_trunc("hour", "ts"), chunk=chunk).orderBy("ts").toPandas()
    assert np.allclose(got["m"], pdf["close"].rolling(10, min_periods=1).mean())
    assert np.allclose(got["nxt"].dropna(), pdf["close"].shift(-2).dropna())
    assert len(got) == 300


def test_prefix_carries_across_blocks(spark):
    pdf, df = walk(spark, 200)
    got = prefix(df, ["symbol"], ["ts"], {"s": ("sum", F.col("volume")), "m": ("max", F.col("high")), "l": ("last", F.when(F.minute("ts") % 7 == 0, F.col("close")))}, F.date_trunc("hour", "ts"), exclusive=True).orderBy("ts").toPandas()
    assert np.allclose(got["s"], pdf["volume"].cumsum().shift(1).fillna(0))
    assert np.allclose(got["m"].iloc[1:], pdf["high"].cummax().shift(1).iloc[1:])
    want = pdf["close"].where(pdf["ts"].dt.minute % 7 == 0).ffill().shift(1)
    assert np.allclose(got["l"].dropna(), want.dropna())


def test_ordinals_with_a_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id")
    got = with_ordinal(df, ["k"], ["id"], F.floor(F.col("id") / 100)).groupBy("k").agg(F.max("ord").alias("m"), F.count("*").alias("n"), F.countDistinct("ord").alias("d")).collect()
    assert all(r.m == r.n == r.d for r in got)


@pytest.mark.parametrize("a", [0.5, 13 / 14, 199 / 201])
def test_affine_recurrence(spark, a):
    pdf, df = walk(spark, 3000)
    got = framed(df, ["symbol"], ["ts"], lambda d, w: d.withColumn("x", affine(w, a, F.col("close") * (1 - a))), before=decay_halo(a), chunk=min(decay_chunk(a), 500)).orderBy("ts").toPandas()
    x, want = 0.0, []
    for c in pdf["close"]:
        x = a * x + c * (1 - a)
        want.append(x)
    assert np.allclose(got["x"], want, rtol=1e-9)


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([np.round(rng.exponential(50, 5000), 1), np.full(2500, 7.0)])
    df = spark.createDataFrame([(i % 2, float(x)) for i, x in enumerate(v)], "g int, v double")
    got = {(r.g, r.p): r.q for r in exact_quantiles(df, ["g"], "v", [0.0, 0.05, 0.5, 0.95, 1.0], parts=5).collect()}
    for g in (0, 1):
        for p in (0.0, 0.05, 0.5, 0.95, 1.0):
            assert got[(g, p)] == pytest.approx(np.percentile(v[g::2], p * 100))


def test_ordered_walk_resets_per_group(spark):
    df = spark.createDataFrame([(g, i) for g in range(3) for i in range(5)], "g int, i int")

    def step(s, row):
        s["n"] += row.i
        return (s["n"],)

    got = ordered_walk(df, ["g"], ["i"], lambda: {"n": 0}, step, "total long").where("i = 4").collect()
    assert [r.total for r in got] == [10, 10, 10]


def test_result_does_not_depend_on_partitioning(spark):
    _, df = walk(spark, 200)
    fn = lambda d: prefix(d, ["symbol"], ["ts"], {"s": ("sum", F.col("volume"))}, F.date_trunc("hour", "ts")).orderBy("ts").toPandas()["s"].tolist()
    assert fn(df.repartition(7)) == fn(df.coalesce(1))


def test_quantiles_of_a_heavy_tail(spark):
    """A group with nearly all rows and values over 600 orders of magnitude: ranges stay near their share, results exact."""
    rng = np.random.default_rng(11)
    values = np.concatenate([10.0 ** rng.uniform(-300, 300, 18_000), -(10.0 ** rng.uniform(-5, 250, 2_000)), np.full(9_000, 1.0)])
    rows = [("hot", float(v)) for v in values] + [("few", 1.0), ("few", 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    dealt = dealt_by_value(df, ["g"], "v", parts=12)
    sizes = [r["count"] for r in dealt.groupBy("__part").count().collect()]
    assert len(sizes) >= 11 and max(sizes) < 2 * sum(sizes) / 12 and dealt.agg(F.sum("__c")).first()[0] == len(rows) - 1
    probs = [0.0, 0.001, 0.5, 0.7, 0.999, 1.0]
    got = {(r.g, r.p): r.q for r in exact_quantiles(df, ["g"], "v", probs, parts=12).collect()}
    x = np.sort(values)
    for p in probs:
        k = p * (len(x) - 1)
        a, z = x[int(np.floor(k))], x[int(np.ceil(k))]
        assert got["hot", p] == a + (z - a) * (k - np.floor(k))
    assert got["few", 0.5] == 2.0 and not any(g == "none" for g, _ in got)
    m = {r.g: r.m for r in medians(df, ["g"], {"m": F.col("v")}).collect()}
    assert m["few"] == 2.0 and "none" not in m
