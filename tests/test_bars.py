import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import bars as B
from barloom.operators import clean as C
from barloom.operators.joins import asof_join, interval_join, range_extremes
from barloom.sources import bars as SB
from tests.fixtures import t, walk


def test_clean_walk_has_no_findings(spark):
    _, df = walk(spark)
    r = C.cleaning_report(df, 1).first()
    assert (r.duplicates, r.anomalous, r.gaps_minor + r.gaps_session + r.gaps_large) == (0, 0, 0)


def test_duplicate_keeps_first_row(spark):
    _, df = walk(spark)
    dup = df.where("ingest_id = 3").withColumns({"ingest_id": F.lit(1000).cast("bigint"), "close": F.lit(1.0)})
    out = C.keep_first(df.unionByName(dup), ["symbol", "ts"], ["ingest_id"])
    assert out.count() == 100 and out.where("close = 1.0").count() == 0
    assert C.cleaning_report(df.unionByName(dup), 1).first().duplicates == 1


def test_anomalies(spark):
    _, df = walk(spark)
    bad = df.withColumn("volume", F.when(F.col("ingest_id") == 5, 0.0).otherwise(F.col("volume"))).withColumn("high", F.when(F.col("ingest_id") == 2, F.col("close") - 5).otherwise(F.col("high")))
    assert sorted(r.ingest_id for r in C.flag_anomalous(bad).where("anomalous").collect()) == [2, 5]


def test_gap_exclusions(spark):
    rows = [("A", t(x)) for x in ("2024-01-02 10:00", "2024-01-02 10:04", "2024-01-02 12:00", "2024-01-02 16:00", "2024-01-02 18:30", "2024-01-04 09:00", "2024-01-05 10:00", "2024-01-08 10:00")]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz")
    got = [r.gap for r in C.detect_gaps(df, 1).orderBy("ts").collect()]
    assert got == [None, "minor", "session", "session", None, "large", "large", None]


def test_completed_bar_is_inclusive_and_never_ahead(spark):
    _, fine = walk(spark, 30)
    coarse = B.resample_ohlcv(fine, 5).select("symbol", F.col("ts").alias("c_ts"))
    got = asof_join(fine, coarse, ["symbol"], "ts", F.col("c_ts") + F.expr("INTERVAL 5 MINUTES"), ["c_ts"]).orderBy("ts").collect()
    assert [r.c_ts for r in got[:5]] == [None] * 5
    assert got[5].c_ts == t("2024-01-02 09:30:00")
    assert all(r.c_ts is None or (r.ts - r.c_ts).total_seconds() >= 300 for r in got)


def test_interval_join_matches_brute_force(spark):
    pdf, df = walk(spark, 400)
    spans = spark.createDataFrame([(i, "AAA", t("2024-01-02 09:30:00").replace(minute=30 + i % 20), t("2024-01-02 12:00:00").replace(minute=i % 60)) for i in range(40)], "id int, symbol string, s timestamp_ntz, e timestamp_ntz")
    got = {r.id: r.n for r in interval_join(spans, df, ["symbol"], "s", "e", "ts", unit="hour", salts=3).groupBy("id").agg(F.count("*").alias("n")).collect()}
    for r in spans.collect():
        assert got[r.id] == int(((pdf.ts >= r.s) & (pdf.ts <= r.e)).sum())


def test_range_extremes_over_many_days(spark):
    pdf, df = walk(spark, 6000)
    spans = spark.createDataFrame([(1, "AAA", t("2024-01-02 10:00:00"), t("2024-01-05 15:00:00")), (2, "AAA", t("2024-01-03 10:00:00"), t("2024-01-03 10:05:00"))], "id int, symbol string, s timestamp_ntz, e timestamp_ntz")
    for r in range_extremes(spans, df, ["symbol"], "id", "s", "e", "ts").join(spans, "id").collect():
        m = pdf[(pdf.ts >= r.s) & (pdf.ts <= r.e)]
        assert np.isclose(r.span_high, m.high.max()) and np.isclose(r.span_low, m.low.min())


def test_bar_text(spark, tmp_path):
    (tmp_path / "f.csv").write_text("Date, Time, Open, High, Low, Last, Volume, NumberOfTrades\n2024/01/02, 09:30:00, 1, 2, 0.5, 1.5, 10, 3\n2024/01/02, 09:31:00, x, 2, 0.5, 1.5, 10, 3\n")
    got = SB.read_bar_text(spark, str(tmp_path / "f.csv"), "AAA").orderBy("ts").collect()
    assert got[0].ts == t("2024-01-02 09:30:00") and got[0].close == 1.5 and got[1].open is None


def test_localize_repeated_and_missing_hour(spark):
    rows = [(i, "AAA", t(x), 1.0) for i, x in enumerate(("2024-11-03 00:30:00", "2024-11-03 01:30:00", "2024-11-03 01:00:00", "2024-11-03 01:30:00", "2024-11-03 02:00:00"))]
    df = spark.createDataFrame(rows, "ingest_id long, symbol string, ts timestamp_ntz, close double")
    got = [str(r.utc)[11:16] for r in SB.localize(df).orderBy("ingest_id").collect()]
    assert got == ["04:30", "05:30", "06:00", "06:30", "07:00"]


def test_bar_text_of_several_files_keeps_their_order(spark, tmp_path):
    head = "Date, Time, Open, High, Low, Last, Volume\n"
    day = lambda k: f"2024/01/{2 + k // 300:02d}, {k // 60 % 5:02d}:{k % 60:02d}:00"
    for symbol in ("AAA", "BBB"):
        (tmp_path / f"symbol={symbol}").mkdir()
        # The larger file is read first by Spark, the smaller one is the first by name; both hold the same times.
        for name, n, price in (("a.csv", 400, 1.0), ("b.csv", 900, 2.0)):
            (tmp_path / f"symbol={symbol}" / name).write_text(head + "".join(f"{day(k)}, {price}, {price}, {price}, {price}, {k}\n" for k in range(n)))
    small = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
        d = SB.read_bar_text(spark, str(tmp_path))
        rows = d.orderBy("ingest_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", small)
    assert [r.ingest_id for r in rows] == list(range(2600))
    assert [(r.symbol, r.open, r.volume) for r in rows] == [(s, p, float(k)) for s in ("AAA", "BBB") for n, p in ((400, 1.0), (900, 2.0)) for k in range(n)]
    kept = C.keep_first(d, ["symbol", "ts"], ["ingest_id"]).where("open = 2.0").groupBy("symbol").count().collect()
    assert {r.symbol: r["count"] for r in kept} == {"AAA": 500, "BBB": 500}
    with pytest.raises(ValueError):
        SB.read_bar_text(spark, str(tmp_path / "symbol=AAA"))
