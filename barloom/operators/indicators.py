"""Indicators over bar tables.

Column builders take the chunk window ``w`` of ``scan.framed`` and may be combined in one pass; the
functions on DataFrames run that pass with the right halo.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.functions.scalar import col, ieee_div, minute_of_day
from barloom.operators.bars import RTH_OPEN, SYM
from barloom.operators.scan import ROWS_TO_HERE, affine, day_of, decay_chunk, decay_halo, framed


def full(w: WindowSpec, c: Column, n: int, agg) -> Column:
    """Aggregate of the last n rows, NULL until n rows exist."""
    f = w.rowsBetween(-n + 1, 0)
    return F.when(F.count(F.lit(1)).over(f) == n, agg(c).over(f))


def sma_col(w: WindowSpec, c, n: int) -> Column:
    return full(w, col(c), n, F.avg)


def crossed_up(w: WindowSpec, a: str, b: str) -> Column:
    return (F.col(a) > F.col(b)) & (F.lag(a).over(w) <= F.lag(b).over(w))


def crossed_down(w: WindowSpec, a: str, b: str) -> Column:
    return (F.col(a) < F.col(b)) & (F.lag(a).over(w) >= F.lag(b).over(w))


def true_range(w: WindowSpec) -> Column:
    pc = F.lag("close").over(w)
    hl = F.col("high") - F.col("low")
    return F.greatest(hl, F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))


def sma_cross(bars: DataFrame, fast: int, slow: int, keys: Sequence[str] = SYM) -> DataFrame:
    def add(d, w):
        d = d.withColumns({"ma_fast": sma_col(w, "close", fast), "ma_slow": sma_col(w, "close", slow)})
        return d.withColumn("cross", F.when(crossed_up(w, "ma_fast", "ma_slow"), 1).when(crossed_down(w, "ma_fast", "ma_slow"), -1).otherwise(0))

    return framed(bars, keys, ["ts"], add, before=slow + 1)


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0, keys: Sequence[str] = SYM) -> DataFrame:
    """Bands at k sample deviations; ``below``/``above`` mark the bar that leaves a band."""
    def add(d, w):
        mid, sd = sma_col(w, "close", n), full(w, F.col("close"), n, F.stddev_samp)
        d = d.withColumns({"mid": mid, "upper": mid + k * sd, "lower": mid - k * sd})
        return d.withColumns({"below": crossed_down(w, "close", "lower"), "above": crossed_up(w, "close", "upper")})

    return framed(bars, keys, ["ts"], add, before=n + 1)


def awesome_oscillator(bars: DataFrame, fast: int = 5, slow: int = 34, keys: Sequence[str] = SYM) -> DataFrame:
    def add(d, w):
        d = d.withColumn("__mid", (F.col("high") + F.col("low")) / 2.0)
        d = d.withColumn("ao", sma_col(w, "__mid", fast) - sma_col(w, "__mid", slow)).drop("__mid")
        a, a1, a2 = F.col("ao"), F.lag("ao", 1).over(w), F.lag("ao", 2).over(w)
        return d.withColumns({
            "zero_cross": F.when(a2.isNull(), 0).when((a > 0) & (a1 <= 0), 1).when((a < 0) & (a1 >= 0), -1).otherwise(0),
            "saucer": F.when((a < 0) & (a1 < 0) & (a2 < 0) & (a1 < a2) & (a > a1), 1)
                       .when((a > 0) & (a1 > 0) & (a2 > 0) & (a1 > a2) & (a < a1), -1).otherwise(0),
        })

    return framed(bars, keys, ["ts"], add, before=slow + 3)


def donchian(bars: DataFrame, n: int, keys: Sequence[str] = SYM, order: str = "ts") -> DataFrame:
    """Extremes of the n bars before the current one (NULL until n exist)."""
    def add(d, w):
        f = w.rowsBetween(-n, -1)
        ok = F.count(F.lit(1)).over(f) == n
        return d.withColumns({"don_high": F.when(ok, F.max("high").over(f)), "don_low": F.when(ok, F.min("low").over(f))})

    return framed(bars, keys, [order], add, before=n)


def vwap_session(bars: DataFrame, keys: Sequence[str] = SYM) -> DataFrame:
    """Volume-weighted price since 09:30 of the day; NULL before."""
    w = Window.partitionBy(*keys, F.to_date("ts")).orderBy("ts").rowsBetween(*ROWS_TO_HERE)
    on = minute_of_day() >= RTH_OPEN
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    pv, v = F.sum(F.when(on, tp * F.col("volume"))).over(w), F.sum(F.when(on, F.col("volume"))).over(w)
    return bars.withColumn("vwap", F.when(on & (v > 0), pv / v))


def vwap_bands(bars: DataFrame, n: int, k: float = 2.0, keys: Sequence[str] = SYM) -> DataFrame:
    """Rolling volume-weighted mean and deviation of the typical price, deviation at least 0.25."""
    def add(d, w):
        f = w.rowsBetween(-n + 1, 0)
        d = d.withColumn("__w", F.collect_list(F.struct(((F.col("high") + F.col("low") + F.col("close")) / 3.0).alias("p"), F.col("volume").alias("v"))).over(f))
        total = lambda g: F.aggregate("__w", F.lit(0.0), lambda a, x: a + g(x))
        cnt = F.size("__w")
        d = d.withColumns({"__v": total(lambda x: x["v"]), "__m": total(lambda x: x["p"]) / cnt})
        d = d.withColumn("band_mid", F.when(F.col("__v") > 0, total(lambda x: x["p"] * x["v"]) / F.nullif("__v", F.lit(0.0))).otherwise(F.element_at("__w", -1)["p"]))
        plain = F.sqrt(total(lambda x: (x["p"] - F.col("__m")) * (x["p"] - F.col("__m"))) / cnt)
        var = total(lambda x: (x["p"] - F.col("band_mid")) * (x["p"] - F.col("band_mid")) * x["v"]) / F.nullif("__v", F.lit(0.0))
        sd = F.when(F.col("__v") > 0, F.when(var > 0, F.sqrt(var)).otherwise(plain)).otherwise(F.when(cnt > 1, plain).otherwise(1.0))
        d = d.withColumn("band_sd", F.greatest(sd, F.lit(0.25)))
        return d.withColumns({"band_upper": F.col("band_mid") + k * F.col("band_sd"), "band_lower": F.col("band_mid") - k * F.col("band_sd")}).drop("__w", "__v", "__m")

    return framed(bars, keys, ["ts"], add, before=n)


def rolling_median(bars: DataFrame, c: Column, n: int, keys: Sequence[str] = SYM, order: str = "ts", prior: bool = False, out: str = "med") -> DataFrame:
    def add(d, w):
        f = w.rowsBetween(-n, -1) if prior else w.rowsBetween(-n + 1, 0)
        d = d.withColumn("__x", c)
        return d.withColumn(out, F.when(F.count("__x").over(f) == n, F.percentile("__x", F.lit(0.5)).over(f))).drop("__x")

    return framed(bars, keys, [order], add, before=n + 1)


def wilder_col(w: WindowSpec, x: Column, seed: Column, period: int, seed_at: int) -> Column:
    """Wilder smoothing of x from a seed at global row ``seed_at``; 0 before it."""
    o = F.col("ord")
    b = F.when(o < seed_at, 0.0).when(o == seed_at, seed).otherwise(x / period)
    return affine(w, (period - 1) / period, b)


def atr(bars: DataFrame, variant: str = "seed_mean_tr", period: int = 14, keys: Sequence[str] = SYM, order: str = "ts", out: str = "atr") -> DataFrame:
    """Average true range.

    ``seed_first`` starts at the first range, ``seed_mean_range``/``seed_mean_tr`` at the mean of the first
    ``period`` ranges (0 before), ``zero_state`` at 0 before the first bar, ``truncated`` restarts 3 periods
    back on every bar, ``rolling`` is a plain mean, ``mean_change`` the mean absolute close change, and
    ``ewm`` equals ``seed_first`` but is NULL for the first ``period`` - 1 bars.
    """
    a = (period - 1) / period
    o = F.col("ord")

    def add(d, w):
        d = d.withColumn("__tr", true_range(w))
        tr = F.col("__tr")
        head = w.rowsBetween(-period + 1, 0)
        if variant in ("seed_first", "ewm"):
            x = affine(w, a, F.when(o == 1, tr).otherwise(tr / period))
            x = F.when(o >= period, x) if variant == "ewm" else x
        elif variant == "seed_mean_range":
            d = d.withColumn("__seed", F.avg(F.col("high") - F.col("low")).over(head))
            x = wilder_col(w, tr, F.col("__seed"), period, period)
        elif variant == "seed_mean_tr":
            d = d.withColumn("__seed", F.avg(tr).over(head))
            x = wilder_col(w, tr, F.col("__seed"), period, period)
        elif variant == "zero_state":
            x = affine(w, a, tr / period)
        elif variant == "truncated":
            d = d.withColumn("__tr", F.when(o > 1, tr))
            d = d.withColumn("__list", F.collect_list("__tr").over(w.rowsBetween(-3 * period, 0)))
            x = F.coalesce(F.aggregate("__list", F.lit(None).cast("double"), lambda s, t: F.when(s.isNull(), t).otherwise(s * a + t / period)), F.lit(0.0))
        elif variant == "rolling":
            x = full(w, tr, period, F.avg)
        elif variant == "mean_change":
            d = d.withColumn("__chg", F.coalesce(F.abs(F.col("close") - F.lag("close").over(w)), F.lit(0.0)))
            x = F.sum("__chg").over(head) / period
        else:
            raise ValueError(f"unknown ATR variant {variant!r}")
        return d.withColumn(out, x).drop("__tr", "__seed", "__list", "__chg")

    recursive = variant in ("seed_first", "ewm", "seed_mean_range", "seed_mean_tr", "zero_state")
    if recursive:
        return framed(bars, keys, [order], add, before=decay_halo(a), chunk=decay_chunk(a))
    return framed(bars, keys, [order], add, before=3 * period + 1)


def rsi(bars: DataFrame, period: int = 14, keys: Sequence[str] = SYM, order: str = "ts") -> DataFrame:
    """Wilder RSI; 50 through the first ``period`` + 1 bars."""
    a = (period - 1) / period
    o = F.col("ord")

    def add(d, w):
        chg = F.col("close") - F.lag("close").over(w)
        d = d.withColumns({"__g": F.greatest(chg, F.lit(0.0)), "__s": F.greatest(-chg, F.lit(0.0))})
        head = w.rowsBetween(-period + 1, 0)
        for c in ("__g", "__s"):
            d = d.withColumn(c + "m", F.avg(c).over(head))
        d = d.withColumns({c + "a": wilder_col(w, F.col(c), F.col(c + "m"), period, period + 1) for c in ("__g", "__s")})
        ratio = F.when(F.col("__sa") > 1e-10, F.col("__ga") / F.nullif("__sa", F.lit(0.0))).otherwise(100.0)
        return d.withColumn("rsi", F.when(o <= period + 1, 50.0).otherwise(100.0 - 100.0 / (1.0 + ratio))).drop("__g", "__s", "__gm", "__sm", "__ga", "__sa")

    return framed(bars, keys, [order], add, before=decay_halo(a), chunk=decay_chunk(a))


def ema_col(w: WindowSpec, c, period: int, reach: int) -> Column:
    """EMA restarted ``reach`` rows back on every row."""
    k = 2.0 / (period + 1)
    window = F.collect_list(col(c)).over(w.rowsBetween(-reach, 0))
    return F.aggregate(window, F.lit(None).cast("double"), lambda s, x: F.when(s.isNull(), x).otherwise(x * k + s * (1.0 - k)))


def ema(bars: DataFrame, period: int, times: int = 3, keys: Sequence[str] = SYM, order: str = "ts") -> DataFrame:
    return framed(bars, keys, [order], lambda d, w: d.withColumn("ema", ema_col(w, "close", period, times * period)), before=times * period)


def short_rsi_col(w: WindowSpec, period: int) -> Column:
    """RSI restarted 6 periods back on every bar (used for RSI(2))."""
    arr = F.collect_list("close").over(w.rowsBetween(-6 * period, 0))
    chg = F.transform(F.sequence(F.lit(2), F.size(arr)), lambda i: F.element_at(arr, i) - F.element_at(arr, i - 1))
    zero = F.lit(0.0)

    def smooth(part):
        xs = F.transform(chg, part)
        seed = F.aggregate(F.slice(xs, 1, period), zero, lambda s, x: s + x) / period
        return F.aggregate(F.slice(xs, period + 1, 6 * period), seed, lambda s, x: (s * (period - 1) + x) / period)

    up, down = smooth(lambda x: F.greatest(x, zero)), smooth(lambda x: F.greatest(-x, zero))
    value = F.when(down == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + up / F.nullif(down, F.lit(0.0))))
    return F.when(F.col("ord") <= period + 1, 50.0).otherwise(value)


def heikin_ashi(bars: DataFrame, keys: Sequence[str] = SYM) -> DataFrame:
    """Averaged candles; ``flip`` is +1/-1 where the colour turns."""
    o = F.col("ord")

    def add(d, w):
        d = d.withColumn("ha_close", (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4.0)
        d = d.withColumn("__b", F.when(o == 1, F.col("open")).otherwise(F.lag("ha_close").over(w) / 2.0))
        d = d.withColumn("ha_open", affine(w, 0.5, F.coalesce("__b", F.lit(0.0))))
        d = d.withColumns({"ha_high": F.greatest("high", "ha_open", "ha_close"), "ha_low": F.least("low", "ha_open", "ha_close")})
        return d.withColumn("flip", F.when(crossed_up(w, "ha_close", "ha_open"), 1).when(crossed_down(w, "ha_close", "ha_open"), -1).otherwise(0)).drop("__b")

    return framed(bars, keys, ["ts"], add, before=decay_halo(0.5) + 2, chunk=decay_chunk(0.5))


def parabolic_sar(bars: DataFrame, initial: float = 0.02, step: float = 0.02, limit: float = 0.2, keys: Sequence[str] = SYM) -> DataFrame:
    """Stop-and-reverse state machine: psar and trend (1, -1; 0 on a series' first bar).

    The recurrence is not associative. Series are hashed over tasks, sorted and streamed; a task remembers the last two
    bars and the state of the series it is in, however long that is.
    """
    columns = list(bars.columns)

    def walk(batches):
        current, n, level, side, peak, af, before = None, 0, 0.0, 0, 0.0, 0.0, ()
        for pdf in batches:
            levels, sides = [], []
            for mark, hi, lo, close in zip(zip(*[pdf[k] for k in keys]), pdf["high"].to_numpy(float), pdf["low"].to_numpy(float), pdf["close"].to_numpy(float)):
                n = 0 if mark != current else n
                if n == 0:
                    current, level, side = mark, 0.0, 0
                elif n == 1:
                    _, hi1, lo1, close1 = before[-1]
                    side = 1 if close > close1 else -1
                    level, peak, af = (lo1, hi, initial) if side > 0 else (hi1, lo, initial)
                else:
                    bound = min(x[2] for x in before) if side > 0 else max(x[1] for x in before)
                    moved = level + af * (peak - level)
                    level = min(moved, bound) if side > 0 else max(moved, bound)
                    if (level > lo) if side > 0 else (level < hi):  # through the stop: reverse at the extreme
                        level, side, af = peak, -side, initial
                        peak = hi if side > 0 else lo
                    elif (hi > peak) if side > 0 else (lo < peak):
                        peak, af = (hi if side > 0 else lo), min(limit, af + step)
                before = (*before[-1:], (n, hi, lo, close)) if n else ((n, hi, lo, close),)
                n += 1
                levels.append(level)
                sides.append(side)
            yield pdf[columns].assign(psar=levels, trend=np.array(sides, dtype=np.int32))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema.fields) + ", psar double, trend int"
    return bars.repartition(*keys).sortWithinPartitions(*keys, "ts").mapInPandas(walk, schema)


def lag_features(daily: DataFrame, keys: Sequence[str] = SYM, order: str = "date") -> DataFrame:
    """Prior close/high/low, overnight and day returns on the day table (one row per day)."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = daily.withColumns({f"prev_{c}": F.lag(c).over(w) for c in ("open", "high", "low", "close")})
    d = d.withColumn("prev2_close", F.lag("close", 2).over(w))
    return d.withColumns({
        "overnight_return": (F.col("open") - F.col("prev_close")) / F.col("prev_close"),
        "day_return": (F.col("close") - F.col("open")) / F.col("open"),
        "close_return": (F.col("close") - F.col("prev_close")) / F.col("prev_close"),
        "prior_day_direction": F.signum(F.col("prev_close") - F.col("prev_open")).cast("int"),
    })


def dual_thrust_levels(daily: DataFrame, n: int = 4, k_up: float = 0.5, k_down: float = 0.5, keys: Sequence[str] = SYM) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("date")
    rng = F.greatest(full(w, F.col("high"), n, F.max) - full(w, F.col("close"), n, F.min),
                     full(w, F.col("close"), n, F.max) - full(w, F.col("low"), n, F.min))
    d = daily.withColumn("__r", rng)
    prev = F.lag("__r").over(w)
    return d.withColumns({"dt_upper": F.col("open") + k_up * prev, "dt_lower": F.col("open") - k_down * prev}).drop("__r")


def noise_band(bars: DataFrame, n_bars: int, bars_per_day: int, m: float = 1.0, keys: Sequence[str] = SYM) -> DataFrame:
    """Day's open +/- m daily deviations of log returns over the n bars before the open bar."""
    def add(d, w):
        d = d.withColumn("__lr", F.ln(F.col("close") / F.lag("close").over(w)))
        f = w.rowsBetween(-n_bars, -1)
        return d.withColumn("__sd", F.when(F.count("__lr").over(f) >= 2, F.stddev_pop("__lr").over(f) * float(np.sqrt(bars_per_day)))).drop("__lr")

    d = framed(bars, keys, ["ts"], add, before=n_bars + 1)
    day = Window.partitionBy(*keys, F.to_date("ts")).orderBy("ts").rowsBetween(*ROWS_TO_HERE)
    at_open = minute_of_day() == RTH_OPEN
    op, sd = F.max(F.when(at_open, F.col("open"))).over(day), F.max(F.when(at_open, F.col("__sd"))).over(day)
    return d.withColumns({"noise_upper": op * (1 + m * sd), "noise_lower": op * (1 - m * sd)}).drop("__sd")


def opening_range(bars: DataFrame, minutes: int, keys: Sequence[str] = SYM) -> DataFrame:
    """High, low, open and close of the first minutes after 09:30, per day."""
    return bars.where(minute_of_day().between(RTH_OPEN, RTH_OPEN + minutes - 1)).groupBy(*keys, F.to_date("ts").alias("date")).agg(
        F.max("high").alias("or_high"), F.min("low").alias("or_low"), F.min_by("open", "ts").alias("or_open"),
        F.max_by("close", "ts").alias("or_close"), F.count(F.lit(1)).alias("or_bars"))


def interval_returns(bars: DataFrame, minutes: int, keys: Sequence[str] = SYM) -> DataFrame:
    """Returns of equal intraday intervals from 09:30 and that of the interval before (same day)."""
    slot = F.floor((minute_of_day() - RTH_OPEN) / minutes)
    d = bars.where(minute_of_day().between(RTH_OPEN, 959)).groupBy(*keys, F.to_date("ts").alias("date"), slot.alias("slot")).agg(
        (ieee_div(F.max_by("close", "ts"), F.min_by("open", "ts")) - 1.0).alias("ret"), F.max("ts").alias("end_ts"))
    return d.withColumn("prev_ret", F.lag("ret").over(Window.partitionBy(*keys, "date").orderBy("slot")))


def atr_pct_rank(daily: DataFrame, lookback: int = 60, period: int = 14, keys: Sequence[str] = SYM) -> DataFrame:
    """Share of the prior ``lookback`` days with a lower ATR percentage; 0.5 where history is short."""
    d = atr(daily, "ewm", period, keys, "date", "__atr").withColumn("atr_pct", F.col("__atr") / F.col("close") * 100.0)
    w = Window.partitionBy(*keys).orderBy("date")
    prior = w.rowsBetween(-lookback, -1)
    d = d.withColumns({"__n": F.row_number().over(w) - 1, "__list": F.collect_list("atr_pct").over(prior)})
    below = F.size(F.filter("__list", lambda x: x < F.col("atr_pct")))
    rank = F.when((F.col("__n") >= lookback) & (F.size("__list") > 0), F.coalesce(below, F.lit(0)) / F.nullif(F.size("__list"), F.lit(0))).otherwise(0.5)
    return d.withColumn("atr_rank", rank).drop("__n", "__list", "__atr")
