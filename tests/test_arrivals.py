import pytest
from pyspark.sql import functions as F

from barloom.plans import catalog_streaming as CS
from barloom.streaming import live as L

BUILDS = {
    "stream_gap_monitor": lambda t: L.stream_gap_monitor(CS.minute_bars(t).select("symbol", "ts"), 1),
    "stream_fvg_ends": lambda t: L.stream_fvg_ends(t.select("symbol", "ts", "event_id", F.col("price").alias("high"), F.col("price").alias("low"))),
}


@pytest.mark.parametrize("name", BUILDS)
def test_a_table_that_arrives_in_pieces(spark, sf, name, monkeypatch):
    """1,000 events as one piece and as several: the same rows, and no micro-batch takes the whole table."""
    whole = sorted(map(tuple, CS.drain_arrivals(BUILDS[name], spark, sf, "whole").collect()))
    places, made = [], CS.fresh
    monkeypatch.setattr(CS, "fresh", lambda s, n: places.append(made(s, n)) or places[-1])
    assert sorted(map(tuple, CS.drain_arrivals(BUILDS[name], spark, sf, "pieces", rows=300).collect())) == whole and len(whole) > 50
    sizes = [r[0] for r in spark.read.parquet(places[0] + "-in").groupBy(F.input_file_name()).count().select("count").collect()]
    assert sum(sizes) == 1000 and max(sizes) < 500
