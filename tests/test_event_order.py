"""Streams of bars that come late and out of order, against a sorted list; windows of long trades."""
import random
from datetime import datetime, timedelta

from barloom.operators import exits
from barloom.streaming import live

START = datetime(2024, 3, 5, 9, 0)


def bars_of(n=400, seed=3):
    rng, at, price, out = random.Random(seed), START, 100.0, []
    for k in range(n):
        at += timedelta(minutes=rng.choice([1, 1, 1, 2, 7]))
        price += rng.choice([-2.0, -1.0, 0.0, 1.0, 2.0])
        for symbol in ("A", "B") if k % 3 else ("A",):
            out.append((symbol, at, k, price + rng.randrange(3), price - rng.randrange(3)))
    return out


def streamed(spark, folder, rows, build):
    """The stream's rows for micro-batches of rows that come in another order; a last bar moves the watermark on."""
    rng = random.Random(5)
    rows = sorted(rows, key=lambda r: r[1] + timedelta(minutes=rng.randrange(25)))
    end = max(r[1] for r in rows) + timedelta(days=2)
    parts = [rows[k:k + 60] for k in range(0, len(rows), 60)] + [[("end", end, 0, 1.0, 1.0)]]
    schema = "symbol string, ts timestamp_ntz, event_id long, high double, low double"
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/in/part={k:03}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    out = build(stream)
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return sorted(tuple(r) for r in spark.read.schema(out.schema).parquet(f"{folder}/out").collect())


def test_gaps_of_shuffled_bars(spark, tmp_path):
    rows, want = bars_of(), []
    for symbol in ("A", "B"):
        times = sorted({r[1] for r in rows if r[0] == symbol})
        for a, b in zip(times, times[1:]):
            minutes = (b - a).total_seconds() // 60
            if minutes > 1 and not 955 <= a.hour * 60 + a.minute <= 1085 and a.weekday() != 4:
                want.append((symbol, a, b, "minor" if minutes <= 5 else "session" if minutes <= 360 else "large"))
    assert streamed(spark, tmp_path, rows, lambda s: live.stream_gap_monitor_late(s, 1, "30 minutes")) == sorted(want)
    assert len(want) > 100


def test_gap_ends_of_shuffled_bars(spark, tmp_path):
    rows, want = bars_of(), []
    for symbol in ("A", "B"):
        own = sorted(r for r in rows if r[0] == symbol)
        for k in range(2, len(own)):
            (_, _, _, h, l), (_, ts, _, high, low) = own[k - 2], own[k]
            side, near, far = (1, h, low) if h < low else (-1, l, high) if l > high else (0, 0, 0)
            end = next((r[1] for r in own[k + 1:] if (r[4] <= near if side > 0 else r[3] >= near)), None)
            if side and end:
                want.append((symbol, ts, end, side, near, far))
    assert streamed(spark, tmp_path, rows, lambda s: live.stream_fvg_ends(s, "30 minutes")) == sorted(want)
    assert len(want) > 10


def test_bars_behind_the_watermark_are_dropped(spark, tmp_path):
    rows = [("A", START + timedelta(minutes=k), k, 1.0, 1.0) for k in range(101)]
    schema = "symbol string, ts timestamp_ntz, event_id long, high double, low double"
    for k, part in enumerate((rows[:40] + rows[60:100], rows[100:], rows[40:60], [("A", START + timedelta(days=1), 0, 1.0, 1.0)], [("end", START + timedelta(days=3), 0, 1.0, 1.0)])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    out = live.stream_gap_monitor_late(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"), 1, "10 minutes")
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.prev_ts, r.ts) for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect())
    assert got == [(rows[39][1], rows[60][1]), (rows[100][1], START + timedelta(days=1))]


def test_pieces_of_a_long_trade(spark):
    n = 5000
    b = spark.createDataFrame([("A", k, START + timedelta(minutes=k), float(k), float(k), float(k), float(k)) for k in range(1, n + 1)], "symbol string, ord long, ts timestamp_ntz, open double, high double, low double, close double")
    t = spark.createDataFrame([(1, "A", 40, 4900), (2, "A", 3, 3), (3, "A", 4999, 5000), (4, "B", 5, 9)], "trade_id long, symbol string, entry_ord long, exit_ord long")
    pieces = exits.trade_window_pieces(t, b, 10, size=64).orderBy("trade_id", "place").collect()
    assert max(len(r.window) for r in pieces) == 64
    whole = {r.trade_id: r for r in exits.trade_windows(t, b, 10).collect()}
    for trade, entry, exit_ in ((1, 40, 4900), (2, 3, 3), (3, 4999, 5000)):
        want = list(range(max(1, entry - 10), min(n, exit_ + 10) + 1))
        own = [r for r in pieces if r.trade_id == trade]
        assert [x.ord for r in own for x in r.window] == want == [x.ord for x in whole[trade].window]
        assert [r.place for r in own] == [r.window[0].ord - want[0] for r in own]
        assert {(r.entry_index, r.exit_index) for r in own} == {(entry - want[0], exit_ - want[0])}
    assert 4 not in whole
