"""Structured Streaming counterparts of the bar operators."""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.operators.bars import session_tag


def timed(df: DataFrame, late: str) -> DataFrame:
    """Event-time watermark on ``ts`` (watermarks need an instant, not a wall-clock time)."""
    return df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def wall(c: str) -> Column:
    return F.col(c).cast("timestamp_ntz")


def stream_resample(ticks: DataFrame, minutes: int, late: str = "10 minutes") -> DataFrame:
    """Ticks to bars; rows later than the watermark are dropped."""
    at = F.struct("ts", "event_id")
    return (
        timed(ticks, late).groupBy(F.window("ts", f"{minutes} minutes"), "symbol")
        .agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
        .select("symbol", wall("window.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def stream_dedup(bars: DataFrame, late: str = "10 minutes") -> DataFrame:
    return timed(bars, late).dropDuplicatesWithinWatermark(["symbol", "ts"]).withColumn("ts", wall("ts"))


def stream_session_levels(bars: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Running high and low per symbol, day and session (update mode)."""
    return timed(bars, late).groupBy(F.window("ts", "1 day").alias("w"), "symbol", session_tag().alias("session")).agg(F.max("high").alias("high"), F.min("low").alias("low")).select(
        "symbol", F.to_date("w.start").alias("date"), "session", "high", "low")


def stream_sliding_vwap(bars: DataFrame, size: str, slide: str, late: str = "10 minutes") -> DataFrame:
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    return timed(bars, late).groupBy(F.window("ts", size, slide), "symbol").agg((F.sum(tp * F.col("volume")) / F.nullif(F.sum("volume"), F.lit(0.0))).alias("vwap")).select(
        "symbol", wall("window.start").alias("start"), wall("window.end").alias("end"), "vwap")


def stream_trade_sessions(trades: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Bursts of activity closed by a quiet gap."""
    return timed(trades, late).groupBy(F.session_window("ts", gap), "symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("total")).select(
        "symbol", wall("session_window.start").alias("start"), wall("session_window.end").alias("end"), "n", "total")


def stream_asof_enrich(bars: DataFrame, levels: DataFrame) -> DataFrame:
    """Live bars with the static level row of their date (levels are already those of the day before)."""
    return bars.withColumn("date", F.to_date("ts")).join(levels, ["symbol", "date"], "left")


def stream_gap_monitor(bars: DataFrame, minutes: int) -> DataFrame:
    """Gaps per symbol; the last bar time is the only state, the batch's bars are taken in time order."""
    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        rows = []
        for ts in sorted(t for pdf in batches for t in pdf["ts"]):
            if last is not None and ts > last:
                size, minute = ts - last, last.hour * 60 + last.minute
                if size > pd.Timedelta(minutes=minutes) and not 955 <= minute <= 1085 and last.weekday() != 4:
                    whole = int(size.total_seconds() // 60)
                    rows.append((key[0], last, ts, "minor" if whole <= 5 else "session" if whole <= 360 else "large"))
            last = ts if last is None else max(last, ts)
        if last is not None:
            state.update((int(last.value // 1000),))
        yield pd.DataFrame(rows, columns=["symbol", "prev_ts", "ts", "gap"])

    return bars.groupBy("symbol").applyInPandasWithState(watch, "symbol string, prev_ts timestamp_ntz, ts timestamp_ntz, gap string", "last long", "append", GroupStateTimeout.NoTimeout)


def stream_fvg(bars: DataFrame) -> DataFrame:
    """New three-bar gaps per symbol; the two bars before are the state."""
    def detect(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        highs, lows = (list(x) for x in state.get) if state.exists else ([], [])
        pdf = pd.concat(list(batches)).sort_values("ts")
        rows = []
        for ts, hi, lo in zip(pdf["ts"], pdf["high"], pdf["low"]):
            if len(highs) == 2:
                if highs[0] < lo:
                    rows.append((key[0], ts, 1, highs[0], lo))
                elif lows[0] > hi:
                    rows.append((key[0], ts, -1, lows[0], hi))
            highs, lows = [*highs, hi][-2:], [*lows, lo][-2:]
        state.update((highs, lows))
        yield pd.DataFrame(rows, columns=["symbol", "ts", "direction", "near", "far"])

    return bars.groupBy("symbol").applyInPandasWithState(detect, "symbol string, ts timestamp_ntz, direction int, near double, far double", "highs array<double>, lows array<double>", "append", GroupStateTimeout.NoTimeout)


def in_event_order(events: DataFrame, late: str, columns: Sequence[str], advance: Callable, output: str) -> DataFrame:
    """Folds each symbol's events in event-time order, whatever order they come in.

    Events wait in the state until the watermark has passed them, so those up to ``late`` behind the newest are put in
    their place, those behind the last batch's watermark are dropped, and the state holds what falls into that time. ``columns``: numbers that
    ``advance(carry, ts, values)`` gets beside the time in microseconds; equal times come in their order. It returns the carry, a list of
    numbers, and output rows (without the symbol).
    """
    names = ["symbol", *(part.split()[0] for part in output.split(", "))]

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, values, carry = (list(x) for x in state.get) if state.exists else ([], [], [])
        for pdf in batches:
            times += (pdf["ts"].astype("int64") // 1000).tolist() if pdf["ts"].dtype.str.endswith("[ns]") else pdf["ts"].astype("datetime64[us]").astype("int64").tolist()
            values += pdf[list(columns)].to_numpy(float).tolist()
        mark, rows = state.getCurrentWatermarkMs() * 1000, []
        held = sorted(zip(times, map(list, values)))
        ready = [x for x in held if x[0] <= mark]
        for ts, own in ready:
            carry, new = advance(carry, ts, own)
            rows += [(key[0], *row) for row in new]
        held = held[len(ready):]
        state.update(([t for t, _ in held], [v for _, v in held], [float(x) for x in carry]))
        if held:  # called again once the watermark reaches the first of them
            state.setTimeoutTimestamp(max(held[0][0] // 1000 - 1, mark // 1000 + 1))
        yield pd.DataFrame(rows, columns=names)

    d = timed(events, late).select("symbol", "ts", *[F.col(c).cast("double").alias(c) for c in columns])
    return d.groupBy("symbol").applyInPandasWithState(fold, f"symbol string, {output}", "times array<long>, held array<array<double>>, carry array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def stream_gap_monitor_late(bars: DataFrame, minutes: int, late: str = "10 minutes") -> DataFrame:
    """``stream_gap_monitor`` for bars that come late or out of order: gaps up to the watermark, as in a sorted table."""
    def advance(carry: list, ts: int, _: list) -> tuple[list, list]:
        if not carry or ts <= carry[0]:
            return carry or [ts], []
        last, at = pd.Timestamp(int(carry[0]), unit="us"), pd.Timestamp(ts, unit="us")
        minute, whole = last.hour * 60 + last.minute, int((at - last).total_seconds() // 60)
        gap = at - last > pd.Timedelta(minutes=minutes) and not 955 <= minute <= 1085 and last.weekday() != 4
        return [ts], [(last, at, "minor" if whole <= 5 else "session" if whole <= 360 else "large")] * gap

    return in_event_order(bars, late, [], advance, "prev_ts timestamp_ntz, ts timestamp_ntz, gap string")


def stream_fvg_ends(bars: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Three-bar gaps that end: the first later bar that trades back to the near edge, in event-time order.

    The state holds the two bars before and the gaps that still live. Bars of one time follow their ``event_id``.
    """
    def advance(carry: list, ts: int, own: list) -> tuple[list, list]:
        n = int(carry[0]) if carry else 0  # bars known: up to two; then (high, low) of each, then four numbers a live gap
        _, high, low = own
        before, live, rows = carry[1:1 + 2 * n], carry[1 + 2 * n:], []
        heaps: tuple[list, list] = ([], [])  # gaps up, the highest edge first; gaps down, the lowest first
        gaps = [live[k:k + 4] for k in range(0, len(live), 4)]
        for side, near, far, since in gaps:
            heaps[side < 0].append((-side * near, since, far))
        for side, heap, reach in ((1, heaps[0], -low), (-1, heaps[1], high)):
            heapify(heap)
            while heap and heap[0][0] <= reach:  # back at the edge: low <= near of a gap up, high >= near of a gap down
                edge, since, far = heappop(heap)
                rows.append((pd.Timestamp(int(since), unit="us"), pd.Timestamp(ts, unit="us"), side, -side * edge, far))
        if n == 2:
            if before[0] < low:
                heappush(heaps[0], (-before[0], ts, low))
            elif before[1] > high:
                heappush(heaps[1], (before[1], ts, high))
        out = [x for side in (1, -1) for edge, since, far in heaps[side < 0] for x in (side, -side * edge, far, since)]
        before = [*before, high, low][-4:]
        return [len(before) // 2, *before, *out], rows

    return in_event_order(bars, late, ["event_id", "high", "low"], advance, "since timestamp_ntz, ts timestamp_ntz, direction int, near double, far double")
