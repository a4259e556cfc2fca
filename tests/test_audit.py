"""The look-ahead audit finds what peeks and leaves alone what does not."""
from pyspark.sql import functions as F

from barloom.operators import indicators as I
from barloom.operators.audit import lookahead_audit
from barloom.operators.scan import framed
from tests.fixtures import walk


def peek(bars):
    return framed(bars, ["symbol"], ["ts"], lambda d, w: d.withColumn("x", F.lead("close", 2).over(w)), after=2).select("symbol", "ts", "x")


def whole_mean(bars):
    return bars.join(bars.groupBy("symbol").agg(F.avg("close").alias("m")), "symbol").select("symbol", "ts", (F.col("close") - F.col("m")).alias("x"))


def drops_the_last(bars):
    return bars.join(bars.groupBy("symbol").agg(F.max("ts").alias("last")), "symbol").where("ts < last").select("symbol", "ts", "close")


def test_audit(spark):
    pdf, df = walk(spark, 300)
    until = sorted(pdf["ts"])[200]
    n = int((pdf["ts"] <= until).sum())
    got = {r.feature: (r.n, r.changed) for r in lookahead_audit(df, {"sma": lambda b: I.sma_cross(b, 3, 8), "peek": peek, "mean": whole_mean, "last": drops_the_last}, until).collect()}
    assert got["sma"] == (n, 0)
    assert got["peek"] == (n, 4)  # two rows lose what they saw: each differs on both sides
    assert got["mean"][1] >= n and got["last"] == (n, 1)
