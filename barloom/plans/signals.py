"""Signal queries: bars in, entries (symbol, ts, direction, ref_price, sl, tp, reason) out."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalar import ibs, minute_of_day, round_to_tick
from barloom.operators import bars as B
from barloom.operators import indicators as I
from barloom.operators import patterns as P
from barloom.operators.joins import level_match, prior_day_join
from barloom.operators.scan import ROWS_BEFORE, framed, with_ordinal
from barloom.operators.sets import daily_signal_cap, dedup_levels, top_n_per_group

SYM = ["symbol"]
ENTRY = ["symbol", "ts", "direction", "ref_price", "sl", "tp", "reason"]
SIGNALS: dict[str, Callable[..., DataFrame]] = {}


def register_signal(name: str):
    """Make a ``bars -> entries`` function available by name; user functions register the same way."""
    def wrap(fn):
        SIGNALS[name] = fn
        return fn
    return wrap


def emit(d: DataFrame, direction: Column, ref: Column, dist: Column, rr: float | Column, reason: str) -> DataFrame:
    """Rows with a direction become entries; stop at ``dist``, target at ``rr`` times it, on the tick grid."""
    d = d.withColumns({"direction": F.coalesce(direction, F.lit(0)).cast("int"), "ref_price": ref, "__dist": dist}).where("direction <> 0")
    way = F.col("direction")
    return d.select("symbol", "ts", "direction", "ref_price", round_to_tick(F.col("ref_price") - way * F.col("__dist")).alias("sl"),
                    round_to_tick(F.col("ref_price") + way * rr * F.col("__dist")).alias("tp"), F.lit(reason).alias("reason"))


def first_per_day(entries: DataFrame, per_side: bool = False) -> DataFrame:
    return daily_signal_cap(entries, SYM, per_side=1) if per_side else daily_signal_cap(entries, SYM, per_day=1)


def side(up: Column, down: Column) -> Column:
    return F.when(up, 1).when(down, -1).otherwise(0)


def in_rth(end: int = 959) -> Column:
    return minute_of_day().between(B.RTH_OPEN, end)


def with_atr(bars: DataFrame, period: int = 14) -> DataFrame:
    return I.atr(bars, "seed_mean_tr", period)


def day_levels(bars: DataFrame, extra: Callable[[DataFrame], DataFrame], cols: Sequence[str]) -> DataFrame:
    """Bars with columns of the day table strictly before their date."""
    d = extra(B.daily_bars(bars, regular_hours=False))
    return prior_day_join(bars, d, SYM, "ts", "date", cols)


def on_resampled(bars: DataFrame, minutes: int, indicator: Callable[[DataFrame], DataFrame], direction: Column, rr: float, reason: str) -> DataFrame:
    """A signal on coarser bars fires on the fine bar that closes them, sized by the fine ATR."""
    s = indicator(B.resample_ohlcv(bars, minutes)).withColumn("__d", direction).where("__d <> 0").select("symbol", F.col("close_ts").alias("ts"), "__d")
    d = with_atr(bars).where(in_rth() & (F.col("atr") > 0)).join(s, ["symbol", "ts"])
    return emit(d, F.col("__d"), F.col("close"), F.col("atr"), rr, reason)


@register_signal("rsi_cross")
def rsi_cross(bars: DataFrame, minutes: int = 30, low: float = 30.0, high: float = 70.0, rr: float = 1.5) -> DataFrame:
    def ind(rs):
        r = I.rsi(rs)
        return framed(r, SYM, ["ts"], lambda d, w: d.withColumn("prev", F.lag("rsi").over(w)), before=1)
    return on_resampled(bars, minutes, ind, side((F.col("rsi") < low) & (F.col("prev") >= low), (F.col("rsi") > high) & (F.col("prev") <= high)), rr, "rsi")


@register_signal("sma_cross_entry")
def sma_cross_entry(bars: DataFrame, minutes: int = 30, fast: int = 5, slow: int = 20, rr: float = 1.5) -> DataFrame:
    return on_resampled(bars, minutes, lambda rs: I.sma_cross(rs, fast, slow), F.col("cross"), rr, "sma_cross")


@register_signal("psar_flip")
def psar_flip(bars: DataFrame, minutes: int = 30, rr: float = 1.5) -> DataFrame:
    def ind(rs):
        return framed(I.parabolic_sar(rs), SYM, ["ts"], lambda d, w: d.withColumn("prev", F.lag("trend").over(w)), before=1)
    return on_resampled(bars, minutes, ind, side((F.col("trend") == 1) & (F.col("prev") == -1), (F.col("trend") == -1) & (F.col("prev") == 1)), rr, "psar")


@register_signal("bollinger_entry")
def bollinger_entry(bars: DataFrame, minutes: int = 30, mode: str = "mean_reversion", rr: float = 1.5) -> DataFrame:
    rev = mode == "mean_reversion"
    return on_resampled(bars, minutes, I.bollinger, side(F.col("below") if rev else F.col("above"), F.col("above") if rev else F.col("below")), rr, f"bollinger_{mode}")


@register_signal("ao_entry")
def ao_entry(bars: DataFrame, minutes: int = 30, mode: str = "zero_cross", rr: float = 1.5) -> DataFrame:
    return on_resampled(bars, minutes, I.awesome_oscillator, F.col(mode), rr, f"ao_{mode}")


@register_signal("heikin_ashi_entry")
def heikin_ashi_entry(bars: DataFrame, minutes: int = 30, no_wick: bool = False, rr: float = 1.5) -> DataFrame:
    wick = F.when(F.col("flip") == 1, F.abs(F.col("ha_open") - F.col("ha_low"))).otherwise(F.abs(F.col("ha_open") - F.col("ha_high")))
    d = F.when(wick >= 0.01, 0).otherwise(F.col("flip")) if no_wick else F.col("flip")
    return on_resampled(bars, minutes, I.heikin_ashi, d, rr, "heikin_ashi")


@register_signal("dual_thrust_entry")
def dual_thrust_entry(bars: DataFrame, n: int = 4, cutoff: int = 930, rr: float = 1.5) -> DataFrame:
    lv = I.dual_thrust_levels(B.daily_bars(bars, regular_hours=False), n).select("symbol", "date", "dt_upper", "dt_lower")
    d = with_atr(bars).withColumn("date", F.to_date("ts")).join(lv, ["symbol", "date"], "left")
    d = framed(d, SYM, ["ts"], lambda x, w: x.withColumn("__d", side(I.crossed_up(w, "close", "dt_upper"), I.crossed_down(w, "close", "dt_lower"))), before=1)
    return emit(d.where(in_rth(cutoff - 1) & (F.col("atr") > 0)), F.col("__d"), F.col("close"), F.col("atr"), rr, "dual_thrust")


@register_signal("shooting_star_hammer")
def shooting_star_hammer(bars: DataFrame, body: float = 0.5, lower: float = 1.0, upper: float = 1.0, rr: float = 2.0) -> DataFrame:
    """A rejection candle confirmed by the next close: stop half an ATR behind its extreme."""
    def add(d, w):
        o, h, l, c, a = (F.lag(x).over(w) for x in ("open", "high", "low", "close", "atr"))
        c2, c3 = F.lag("close", 2).over(w), F.lag("close", 3).over(w)
        size = F.abs(o - c)
        small, base = size < body * a, size + 0.001
        top, bot = h - F.greatest(o, c), F.least(o, c) - l
        star = ((o >= c) | (size < 0.1 * a)) & small & (bot < lower * base) & (top >= upper * base) & (c2 < c) & (c3 < c2) & (F.col("close") < c)
        hammer = (c >= o) & small & (top < lower * base) & (bot >= upper * base) & (c2 > c) & (c3 > c2) & (F.col("close") > c)
        stop = F.when(star, round_to_tick(h + 0.5 * a)).otherwise(round_to_tick(l - 0.5 * a))
        return d.withColumns({"__d": F.when((a > 0) & (F.col("atr") > 0), side(hammer, star)).otherwise(0), "__dist": F.abs(stop - F.col("close")), "__ok": F.when(star, stop > F.col("close")).otherwise(stop < F.col("close"))})

    d = framed(with_atr(bars), SYM, ["ts"], add, before=3).where(in_rth() & F.col("__ok"))
    return emit(d, F.col("__d"), F.col("close"), F.col("__dist"), rr, "rejection_candle")


@register_signal("pre_session_breakout")
def pre_session_breakout(bars: DataFrame, start: int = 180, cutoff: int = 930, rr: float = 1.5) -> DataFrame:
    lv = B.pre_session_range(bars, start, B.RTH_OPEN).select("symbol", "date", "pre_high", "pre_low")

    def add(d, w):
        prev = F.lag("close").over(w)
        return d.withColumn("__d", side((F.col("close") > F.col("pre_high")) & (prev <= F.col("pre_high")), (F.col("close") < F.col("pre_low")) & (prev >= F.col("pre_low"))))

    d = with_atr(bars).withColumn("date", F.to_date("ts")).join(lv, ["symbol", "date"], "left")
    d = framed(d, SYM, ["ts"], add, before=1).where(in_rth(cutoff - 1) & (F.col("atr") > 0))
    return emit(d, F.col("__d"), F.col("close"), F.col("atr"), rr, "pre_session_breakout")


@register_signal("vwap_reversion")
def vwap_reversion(bars: DataFrame, dev: float = 1.0, delay: int = 30, end: int = 930, rr: float = 1.5) -> DataFrame:
    """First close too far below (above) the session VWAP, one per side and day."""
    d = I.vwap_session(I.atr(bars, "seed_first")).where(minute_of_day().between(B.RTH_OPEN + delay, end - 1) & (F.col("atr") > 0))
    gap = F.col("close") - F.col("vwap")
    return first_per_day(emit(d, side(gap < -dev * F.col("atr"), gap > dev * F.col("atr")), F.col("close"), F.col("atr"), rr, "vwap_reversion"), per_side=True)


@register_signal("vwap_band_fade")
def vwap_band_fade(bars: DataFrame, n: int = 20, k: float = 2.0, ema: int = 10, structure: float = 10.0, per_day: int = 2) -> DataFrame:
    """Limit entry at a VWAP band against the EMA side, near yesterday's extreme; target is the VWAP."""
    d = I.ema(I.vwap_bands(I.atr(bars, "truncated"), n, k), ema)
    lv = I.lag_features(B.daily_bars(bars)).select("symbol", "date", "prev_high", "prev_low")
    d = d.withColumn("date", F.to_date("ts")).join(lv, ["symbol", "date"], "left").where(in_rth() & (F.col("atr") > 0))
    c = F.col("close")
    way = side((c <= F.col("band_lower")) & (c > F.col("ema")), (c >= F.col("band_upper")) & (c < F.col("ema")))
    near = F.col("prev_high").isNull() | (F.abs(c - F.col("prev_high")) <= structure) | (F.abs(c - F.col("prev_low")) <= structure)
    band = F.when(way == 1, F.col("band_lower")).otherwise(F.col("band_upper"))
    d = d.withColumns({"__w": way, "__b": band}).where(near & (F.abs(F.col("band_mid") - band) >= 0.5 * F.col("atr")))
    e = emit(d, F.col("__w"), F.col("__b"), F.col("atr"), F.abs(F.col("band_mid") - F.col("__b")) / F.col("atr"), "vwap_band")
    return daily_signal_cap(e, SYM, per_day=per_day)


@register_signal("ibs_open")
def ibs_open(bars: DataFrame, low: float = 0.2, high: float = 0.8, mult: float = 1.0, rr: float = 1.5) -> DataFrame:
    """At the regular open, against a prior day that closed near its extreme."""
    d = day_levels(bars, lambda x: I.atr(x, "rolling", 14, order="date").withColumn("ibs", ibs()), ["ibs", "atr"])
    d = d.where((minute_of_day() == B.RTH_OPEN) & (F.col("atr") > 0))
    return emit(d, side(F.col("ibs") < low, F.col("ibs") > high), F.col("open"), mult * F.col("atr"), rr, "ibs")


@register_signal("ibs_rsi_close")
def ibs_rsi_close(bars: DataFrame, at: int = 959, ema: int = 200, ibs_low: float = 0.3, rsi_low: float = 40.0, rr: float = 1.5, trend: bool = True) -> DataFrame:
    def add(d, w):
        return d.withColumns({"rsi2": I.short_rsi_col(w, 2), "ema": I.ema_col(w, "close", ema, 4 * ema), "ibs": ibs()})

    d = framed(I.atr(bars, "truncated"), SYM, ["ts"], add, before=4 * ema).where((minute_of_day() == at) & (F.col("atr") > 0))
    up = (F.col("ibs") <= ibs_low) & (F.col("rsi2") <= rsi_low)
    down = (F.col("ibs") >= 1 - ibs_low) & (F.col("rsi2") >= 100 - rsi_low)
    if trend:
        up, down = up & (F.col("close") > F.col("ema")), down & (F.col("close") < F.col("ema"))
    return emit(d, side(up, down), F.col("close"), F.col("atr"), rr, "ibs_rsi")


@register_signal("orb_atr")
def orb_atr(bars: DataFrame, mult: float = 0.1, start: int = 600, end: int = 930, rr: float = 1.5) -> DataFrame:
    """Close beyond the opening price +/- a share of the daily ATR, once per side and day."""
    d = day_levels(bars, lambda x: I.atr(x, "rolling", 5, order="date", out="atr5"), ["atr5"])
    op = B.daily_bars(bars.where(minute_of_day() == B.RTH_OPEN)).select("symbol", "date", F.col("open").alias("orb_open"))
    d = d.withColumn("date", F.to_date("ts")).join(op, ["symbol", "date"]).where(minute_of_day().between(start, end - 1) & (F.col("atr5") > 0))
    room = mult * F.col("atr5")
    e = emit(d, side(F.col("close") >= round_to_tick(F.col("orb_open") + room), F.col("close") <= round_to_tick(F.col("orb_open") - room)), F.col("close"), F.col("atr5") * 0.25, rr, "orb_atr")
    return first_per_day(e, per_side=True)


@register_signal("orb_trend")
def orb_trend(bars: DataFrame, mult: float = 0.1, fast: int = 20, slow: int = 100, sl_pct: float = 0.1, rr: float = 2.0) -> DataFrame:
    """Jump of a share of the daily ATR over the last close, with the daily trend; first of the day."""
    def daily(x):
        w = Window.partitionBy(*SYM).orderBy("date")
        return I.atr(x, "rolling", 5, order="date", out="atr5").withColumns({"sf": I.sma_col(w, "close", fast), "ss": I.sma_col(w, "close", slow)})

    d = day_levels(bars, daily, ["atr5", "sf", "ss"])
    d = framed(d, SYM, ["ts"], lambda x, w: x.withColumn("pc", F.lag("close").over(w)), before=1).where(minute_of_day().between(600, 929) & (F.col("atr5") > 0))
    room = mult * F.col("atr5")
    way = side((F.col("close") > round_to_tick(F.col("pc") + room)) & (F.col("sf") > F.col("ss")), (F.col("close") < round_to_tick(F.col("pc") - room)) & (F.col("sf") < F.col("ss")))
    return first_per_day(emit(d, way, F.col("open"), F.col("open") * sl_pct, rr, "orb_trend"))


@register_signal("orb_stop")
def orb_stop(bars: DataFrame, minutes: int = 60, atr_mult: float = 1.0, min_range: float = 0.1, max_range: float = 5.0, rr: float = 2.0) -> DataFrame:
    """Stop order a tick beyond the opening range in the range's direction, placed on the first bar after it."""
    rng = I.opening_range(bars, minutes)
    d = I.atr(bars, "truncated").withColumn("date", F.to_date("ts")).where(minute_of_day() >= B.RTH_OPEN + minutes)
    d = top_n_per_group(d, ["symbol", "date"], [F.col("ts")], 1).join(rng, ["symbol", "date"])
    size = F.col("or_high") - F.col("or_low")
    d = d.where((F.col("atr") > 0) & size.between(min_range * F.col("atr"), max_range * F.col("atr")) & (size > 0))
    up = F.col("or_close") >= F.col("or_open")
    ref = F.when(up, round_to_tick(F.col("or_high") + 0.25)).otherwise(round_to_tick(F.col("or_low") - 0.25))
    return emit(d, side(up, ~up), ref, round_to_tick(F.greatest(atr_mult * F.col("atr"), F.lit(1.0))), rr, "orb_stop")


@register_signal("enhanced_orb")
def enhanced_orb(bars: DataFrame, minutes: int = 60, candles: int = 2, reverse: bool = False, second_chance: bool = True, rr: float = 2.0) -> DataFrame:
    """Consecutive closes beyond the opening range; the day's first break, then the first opposite one."""
    rng = I.opening_range(bars, minutes).select("symbol", "date", "or_high", "or_low")
    d = I.atr(bars, "truncated").withColumn("date", F.to_date("ts")).join(rng, ["symbol", "date"]).where(minute_of_day() >= B.RTH_OPEN + minutes)
    d = d.withColumn("__o", side(F.col("close") > F.col("or_high"), F.col("close") < F.col("or_low")))
    w = Window.partitionBy("symbol", "date").orderBy("ts")
    last = w.rowsBetween(-candles + 1, 0)
    same = (F.count(F.lit(1)).over(last) == candles) & (F.min("__o").over(last) == F.max("__o").over(last))
    d = d.withColumn("__d", F.when(same, F.col("__o")).otherwise(0)).where("__d <> 0")
    firsts = top_n_per_group(d, ["symbol", "date", "__d"], [F.col("ts")], 1)
    d = firsts if second_chance else top_n_per_group(firsts, ["symbol", "date"], [F.col("ts")], 1)
    return emit(d.where("atr > 0"), -F.col("__d") if reverse else F.col("__d"), F.col("close"), F.col("atr"), rr, "enhanced_orb")


@register_signal("trend_following")
def trend_following(bars: DataFrame, fast: int = 50, slow: int = 100, lookback: int = 200, mult: float = 2.0) -> DataFrame:
    """Daily trend with a close beyond the prior days' extreme; trailed from the day before, no target."""
    def daily(x):
        w = Window.partitionBy(*SYM).orderBy("date")
        x = I.atr(x, "rolling", 14, order="date", out="atr14").withColumns({"sf": I.sma_col(w, "close", fast), "ss": I.sma_col(w, "close", slow)})
        f = w.rowsBetween(-lookback, -1)
        ok = F.count(F.lit(1)).over(f) == lookback
        return x.withColumns({"hh": F.when(ok, F.max("high").over(f)), "ll": F.when(ok, F.min("low").over(f)), "ph": F.lag("high").over(w), "pl": F.lag("low").over(w), "dc": F.col("close")})

    cols = ["atr14", "sf", "ss", "hh", "ll", "ph", "pl", "dc"]
    d = day_levels(bars, daily, cols).withColumn("date", F.to_date("ts"))
    d = top_n_per_group(d, ["symbol", "date"], [F.col("ts")], 1).where(F.col("atr14") > 0)
    way = side((F.col("sf") > F.col("ss")) & (F.col("dc") > F.col("hh")), (F.col("sf") < F.col("ss")) & (F.col("dc") < F.col("ll")))
    stop = F.when(way == 1, F.col("ph") - mult * F.col("atr14")).otherwise(F.col("pl") + mult * F.col("atr14"))
    d = d.withColumns({"direction": way, "sl": round_to_tick(stop), "ref_price": F.col("open"), "tp": F.lit(None).cast("double"), "reason": F.lit("trend")})
    return d.where("direction <> 0 and sl is not null").select(*ENTRY)


@register_signal("turtle_soup")
def turtle_soup(bars: DataFrame, lookback: int = 5, rr: float = 1.5, atr: int = 14) -> DataFrame:
    """Fade of a completed 4-hour extreme: close back inside, first of each 4-hour bar."""
    four = B.resample_ohlcv(bars, 240, offset=0)

    def mark(d, w):
        f = w.rowsBetween(-lookback + 1, -1)
        ok = F.count(F.lit(1)).over(f) == lookback - 1
        new_high, new_low = ok & (F.col("high") >= F.max("high").over(f)), ok & (F.col("low") <= F.min("low").over(f))
        return d.withColumns({"next_ts": F.lead("ts").over(w), "brk_high": F.when(new_high, F.col("high")), "brk_low": F.when(new_low, F.col("low"))})

    lv = framed(four, SYM, ["ts"], mark, before=lookback, after=1).select("symbol", F.col("next_ts").alias("bin"), "brk_high", "brk_low").where("bin is not null")
    d = I.atr(bars, "mean_change", atr).withColumn("bin", B.bar_start("ts", 240)).join(lv, ["symbol", "bin"]).where(in_rth() & (F.col("atr") > 0))
    c = F.col("close")
    way = side(F.coalesce(c > F.col("brk_low"), F.lit(False)) & ~F.coalesce(c < F.col("brk_high"), F.lit(False)), c < F.col("brk_high"))
    level = F.when(way == 1, F.col("brk_low")).otherwise(F.col("brk_high"))
    e = emit(d.withColumns({"__w": way, "__l": level}), F.col("__w"), c, F.col("atr") + F.abs(c - F.col("__l")), rr, "turtle_soup")
    return top_n_per_group(e.withColumn("__b", B.bar_start("ts", 240)), ["symbol", "__b"], [F.col("ts")], 1).drop("__b")


@register_signal("asia_range")
def asia_range(bars: DataFrame, mode: str = "breakout", style: str = "momentum", start: int = 1200, entry: int = 120, rr: float = 1.5, min_range: float = 0.1, max_range: float = 50.0) -> DataFrame:
    """Overnight range traded by a stop beyond it, a fade at its edge, or confirmed at the New York open."""
    rng = B.pre_session_range(bars, start, entry)
    at = B.RTH_OPEN if mode == "ny_confirm" else entry
    d = I.atr(bars, "truncated").withColumn("date", F.to_date("ts")).where(minute_of_day() == at).join(rng, ["symbol", "date"])
    size = F.col("pre_high") - F.col("pre_low")
    d = d.where((F.col("atr") > 0) & size.between(min_range * F.col("atr"), max_range * F.col("atr")))
    trend = side(F.col("pre_close") > F.col("pre_open"), F.col("pre_close") < F.col("pre_open"))
    way = {"momentum": trend, "contrarian": -trend, "long": F.lit(1), "short": F.lit(-1)}[style]
    d = d.withColumn("__w", way)
    up = F.col("__w") == 1
    if mode == "ny_confirm":
        d = d.where(F.when(up, F.col("open") > F.col("pre_high")).otherwise(F.col("open") < F.col("pre_low")))
        ref = F.col("open")
    elif mode == "fade":
        ref = round_to_tick(F.when(up, F.col("pre_low")).otherwise(F.col("pre_high")))
    else:
        ref = round_to_tick(F.when(up, F.col("pre_high") + 0.25).otherwise(F.col("pre_low") - 0.25))
    return emit(d, F.col("__w"), ref, round_to_tick(F.greatest(F.col("atr"), F.lit(1.0))), rr, f"asia_{mode}")


def _open_gap(bars: DataFrame, at: int, regular: bool) -> DataFrame:
    """The bar at a minute of day with the last close of the day before."""
    d = prior_day_join(bars, B.daily_bars(bars, regular_hours=regular).withColumn("pc", F.col("close")), SYM, "ts", "date", ["pc"])
    return d.where((minute_of_day() == at) & (F.col("pc") > 0))


@register_signal("gap_fill")
def gap_fill(bars: DataFrame, frac: float = 0.5, min_gap: float = 0.1, max_gap: float = 10.0) -> DataFrame:
    """Fade the opening gap back to the prior close."""
    d = _open_gap(I.atr(bars, "truncated"), B.RTH_OPEN, False)
    gap = F.col("open") - F.col("pc")
    d = d.where((F.col("atr") > 0) & (F.abs(gap) >= 1e-6) & (F.abs(gap) / F.col("atr")).between(min_gap, max_gap))
    dist = round_to_tick(F.greatest(F.abs(gap) * frac, F.lit(1.0)))
    d = d.withColumn("pc", F.col("pc")).withColumn("__g", gap)
    e = emit(d, side(F.col("__g") < 0, F.col("__g") > 0), F.col("open"), dist, F.abs(F.col("__g")) / dist, "gap_fill")
    return e


@register_signal("overnight_reversal")
def overnight_reversal(bars: DataFrame, threshold: float = 0.001, rr: float = 1.5) -> DataFrame:
    d = _open_gap(I.atr(bars, "truncated"), B.RTH_OPEN, True)
    r = (F.col("open") - F.col("pc")) / F.col("pc")
    return emit(d, F.when(F.abs(r) < threshold, 0).otherwise(F.when(r > 0, -1).otherwise(1)), F.col("open"), F.col("atr"), rr, "overnight_reversal")


@register_signal("overnight_momentum")
def overnight_momentum(bars: DataFrame, open_at: int = 510, enter_at: int = 900, threshold: float = 0.001, dual: bool = True, rr: float = 1.5) -> DataFrame:
    lv = I.lag_features(B.daily_bars(bars, regular_hours=False)).select("symbol", "date", "prev_close", "prev2_close")
    op = bars.where(minute_of_day() == open_at).select("symbol", F.to_date("ts").alias("date"), F.col("open").alias("day_open"))
    d = I.atr(bars, "truncated").where(minute_of_day() == enter_at).withColumn("date", F.to_date("ts")).join(lv, ["symbol", "date"]).join(op, ["symbol", "date"])
    d = d.where(F.col("prev_close") > 0)
    r = F.col("day_open") / F.col("prev_close") - 1.0
    way = F.when(F.abs(r) < threshold, 0).otherwise(F.when(r > 0, 1).otherwise(-1))
    if dual:
        prior = F.when(F.col("prev_close") / F.col("prev2_close") - 1.0 > 0, 1).otherwise(-1)
        way = F.when(F.col("prev2_close").isNotNull() & (prior != way), 0).otherwise(way)
    return emit(d, way, F.col("close"), F.col("atr"), rr, "overnight_momentum")


@register_signal("last_hour_momentum")
def last_hour_momentum(bars: DataFrame, at: int = 900, threshold: float = 0.001, rr: float = 1.5) -> DataFrame:
    d = _open_gap(I.atr(bars, "truncated"), at, False)
    r = F.col("close") / F.col("pc") - 1.0
    return emit(d, F.when(F.abs(r) < threshold, 0).otherwise(F.when(r > 0, 1).otherwise(-1)), F.col("close"), F.col("atr"), rr, "last_hour_momentum")


@register_signal("window_momentum")
def window_momentum(bars: DataFrame, start: int = 510, end: int = 570, enter_at: int = 900, threshold: float = 0.001, range_atr: float = 0.0, rr: float = 1.5) -> DataFrame:
    """Return of the first window (to the bar that ends it) carried into the last."""
    m = minute_of_day()
    g = bars.where(m >= start).groupBy("symbol", F.to_date("ts").alias("date")).agg(
        F.max(F.when(m == start, F.col("open"))).alias("w_open"), F.min_by("close", F.when(m >= end, F.col("ts"))).alias("w_close"),
        (F.max(F.when(m < end, F.col("high"))) - F.min(F.when(m < end, F.col("low")))).alias("w_range"))
    d = I.atr(bars, "truncated").where(m == enter_at).withColumn("date", F.to_date("ts")).join(g, ["symbol", "date"]).where(F.col("w_open") > 0)
    r = F.col("w_close") / F.col("w_open") - 1.0
    way = F.when((F.abs(r) < threshold) | (F.col("w_range") < range_atr * F.col("atr")), 0).otherwise(F.when(r > 0, 1).otherwise(-1))
    return emit(d, way, F.col("close"), F.col("atr"), rr, "window_momentum")


@register_signal("interval_momentum")
def interval_momentum(bars: DataFrame, minutes: int = 90, threshold: float = 0.001, per_day: int = 2, rr: float = 1.5) -> DataFrame:
    """Direction of an interval from its open to the bar that ends it; entered on that bar."""
    slot = lambda ts: F.floor((minute_of_day(ts) - B.RTH_OPEN) / minutes)
    m = minute_of_day()
    opens = bars.where(in_rth() & ((m - B.RTH_OPEN) % minutes == 0)).select("symbol", F.to_date("ts").alias("date"), (slot("ts") + 1).alias("slot"), F.col("open").alias("i_open"))
    ends = I.atr(bars, "truncated").where(m.between(B.RTH_OPEN + minutes, 960) & ((m - B.RTH_OPEN) % minutes == 0)).withColumns({"date": F.to_date("ts"), "slot": slot("ts")})
    d = ends.join(opens, ["symbol", "date", "slot"]).where(F.col("i_open") > 0)
    r = F.col("close") / F.col("i_open") - 1.0
    e = emit(d, F.when(F.abs(r) < threshold, 0).otherwise(F.when(r > 0, 1).otherwise(-1)), F.col("close"), F.col("atr"), rr, "interval_momentum")
    return daily_signal_cap(e, SYM, per_day=per_day)


@register_signal("noise_boundary")
def noise_boundary(bars: DataFrame, n_bars: int = 65, bars_per_day: int = 13, m: float = 0.5, per_day: int = 1, rr: float = 2.0) -> DataFrame:
    d = I.noise_band(I.atr(bars, "truncated"), n_bars, bars_per_day, m)
    d = d.where(minute_of_day().between(B.RTH_OPEN, 930) & (F.minute("ts") % 30 == 0))
    way = side(F.col("close") > F.col("noise_upper"), F.col("close") < F.col("noise_lower"))
    ref = F.when(way == 1, F.col("noise_upper")).otherwise(F.col("noise_lower"))
    return daily_signal_cap(emit(d.withColumns({"__w": way, "__r": ref}), F.col("__w"), F.col("__r"), F.col("atr"), rr, "noise_boundary"), SYM, per_day=per_day)


def _breaks(bars: DataFrame, n: int) -> DataFrame:
    """(symbol, ts, broke_high, broke_low) for bars that break structure."""
    b = P.break_of_structure(bars, n).groupBy("symbol", F.col("bos_ts").alias("ts"))
    return b.agg(F.max(F.col("kind") == "H").alias("broke_high"), F.max(F.col("kind") == "L").alias("broke_low"))


@register_signal("anchored_reversion")
def anchored_reversion(bars: DataFrame, n: int = 2, body_share: float = 0.5, window: int = 390, against: int = 60, skip: int = 0, beyond: float | None = None, stop: float = 20.0, rr: float = 1.5, direction_filter: bool = True) -> DataFrame:
    """Displacement candle that breaks structure back towards the session's opening price."""
    d = B.fair_price(P.candle_shape(with_atr(bars))).where(F.col("session") != "OFF").join(_breaks(bars, n), ["symbol", "ts"])
    start = F.when(F.col("session") == "ASIA", 1200).when(F.col("session") == "LONDON", 120).otherwise(B.RTH_OPEN)
    d = d.withColumn("elapsed", minute_of_day() - start).where((F.col("atr") > 0) & F.col("elapsed").between(skip, window - 1))
    c, fair, first = F.col("close"), F.col("fair"), (F.col("elapsed") <= against) | F.lit(not direction_filter)
    up = F.col("broke_high") & (c >= F.col("open")) & (F.col("bull_pos") >= body_share) & ((c < fair) | first)
    down = F.col("broke_low") & (c < F.col("open")) & (F.col("bear_pos") >= body_share) & ((c > fair) | first)
    if beyond is not None:
        reach = stop * rr
        up = up & ~((c < fair) & (c + reach > fair) & ((fair - c) / reach < beyond))
        down = down & ~((c > fair) & (c - reach < fair) & ((c - fair) / reach < beyond))
    return emit(d, side(up, down), c, F.lit(stop), rr, "anchored_reversion")


@register_signal("session_reversion")
def session_reversion(bars: DataFrame, wick: float = 0.4, min_atr: float = 0.3, vol: float = 0.5, rr: float = 1.5, momentum_only: bool = False, require_daily: bool = False, per_day: int = 3) -> DataFrame:
    """Displacement through the prior bar that breaks the session's structure, by trend and volatility."""
    d = framed(with_atr(bars), SYM, ["ts"], lambda x, f: x.withColumn("med", F.percentile("atr", F.lit(0.5)).over(f.rowsBetween(-19, 0))), before=19)
    d = B.fair_price(d).where(F.col("session") != "OFF")
    w = Window.partitionBy("symbol", "date", "session").orderBy("ts")
    lag = lambda c, k: F.lag(c, k).over(w)
    d = d.withColumns({
        "ph": lag("high", 1), "pl": lag("low", 1),
        "sh": F.when((lag("high", 2) > lag("high", 3)) & (lag("high", 2) > lag("high", 1)), lag("high", 2)), "slo": F.when((lag("low", 2) < lag("low", 3)) & (lag("low", 2) < lag("low", 1)), lag("low", 2))})
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"swing_hi": F.last("sh", True).over(upto), "swing_lo": F.last("slo", True).over(upto), "hi_no": F.count("sh").over(upto), "lo_no": F.count("slo").over(upto)})
    d = d.withColumns({"__ub": F.col("close") > F.col("swing_hi"), "__db": F.col("close") < F.col("swing_lo")})
    used = lambda flag, no: F.coalesce(F.max(F.col(flag).cast("int")).over(Window.partitionBy("symbol", "date", "session", no).orderBy("ts").rowsBetween(*ROWS_BEFORE)), F.lit(0)) == 0
    d = d.withColumns({"bull_bos": F.col("__ub") & used("__ub", "hi_no"), "bear_bos": F.col("__db") & used("__db", "lo_no")})
    lv = I.lag_features(B.daily_bars(bars, regular_hours=False)).select("symbol", "date", "prior_day_direction")
    d = d.join(lv, ["symbol", "date"], "left").where((F.col("atr") > 0) & (F.col("atr") >= vol * F.col("med")) & (F.col("high") - F.col("low") >= min_atr * F.col("atr")))
    c, o, rng, fair, reach = F.col("close"), F.col("open"), F.nullif(F.col("high") - F.col("low"), F.lit(0.0)), F.col("fair"), rr * F.col("atr")
    up = (c > F.col("ph")) & (c > o) & ((F.col("high") - c) / rng <= wick) & F.col("bull_bos") & (c != fair) & ~((c < fair) & (c + reach > fair))
    down = (c < F.col("pl")) & (c < o) & ((c - F.col("low")) / rng <= wick) & F.col("bear_bos") & (c != fair) & ~((c > fair) & (c - reach < fair))
    if momentum_only:
        up, down = up & (c > fair), down & (c < fair)
    if require_daily:
        up, down = up & (F.coalesce("prior_day_direction", F.lit(0)) >= 0), down & (F.coalesce("prior_day_direction", F.lit(0)) <= 0)
    return daily_signal_cap(emit(d, side(up, down), c, F.col("atr"), rr, "session_reversion"), SYM, per_day=per_day)


def double_sweep_state(bars: DataFrame) -> DataFrame:
    """First-event times per day: Asia range, one-sided London sweep, New York sweep of the London extreme."""
    m = minute_of_day()
    asia = B.pre_session_range(bars, 1200, 120).select("symbol", "date", F.col("pre_high").alias("asia_high"), F.col("pre_low").alias("asia_low"))
    d = bars.withColumn("date", F.to_date("ts")).join(asia, ["symbol", "date"])
    lon, ny = m.between(120, 299), m.between(B.RTH_OPEN, 959)
    g = d.groupBy("symbol", "date", "asia_high", "asia_low").agg(
        F.min(F.when(lon & (F.col("high") > F.col("asia_high")), F.col("ts"))).alias("lon_up"), F.min(F.when(lon & (F.col("low") < F.col("asia_low")), F.col("ts"))).alias("lon_down"),
        F.max(F.when(lon, F.col("high"))).alias("lon_high"), F.min(F.when(lon, F.col("low"))).alias("lon_low"))
    g = g.withColumn("bias", side(F.col("lon_down").isNotNull() & F.col("lon_up").isNull(), F.col("lon_up").isNotNull() & F.col("lon_down").isNull())).where("bias <> 0")
    d = bars.where(ny).withColumn("date", F.to_date("ts")).join(g, ["symbol", "date"])
    swept = F.when(F.col("bias") == 1, F.col("low") < F.col("lon_low")).otherwise(F.col("high") > F.col("lon_high"))
    ext = d.groupBy("symbol", "date").agg(F.min(F.when(swept, F.col("ts"))).alias("ny_sweep"))
    return g.join(ext, ["symbol", "date"])


@register_signal("double_sweep")
def double_sweep(bars: DataFrame, n: int = 2, rr: float = 2.0, max_range: float = 3.0) -> DataFrame:
    """After both sweeps, the first break of structure in the bias direction; wide Asia days are skipped."""
    st = double_sweep_state(bars).where(F.col("ny_sweep").isNotNull())
    rng = B.pre_session_range(bars, 1200, 120).withColumn("rng", F.col("pre_high") - F.col("pre_low")).select("symbol", "date", "rng")
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(-30, -1)
    med = rng.withColumn("med", F.percentile("rng", F.lit(0.5)).over(w)).select("symbol", "date", "rng", "med")
    st = st.join(med, ["symbol", "date"]).where(F.col("med").isNull() | (F.col("rng") <= max_range * F.col("med")))
    d = with_atr(bars).where(in_rth()).withColumn("date", F.to_date("ts")).join(_breaks(bars, n), ["symbol", "ts"]).join(st, ["symbol", "date"]).where(F.col("ts") > F.col("ny_sweep"))
    way = F.when((F.col("bias") == 1) & F.col("broke_high"), 1).when((F.col("bias") == -1) & F.col("broke_low"), -1).otherwise(0)
    return first_per_day(emit(d.where("atr > 0"), way, F.col("close"), F.col("atr"), rr, "double_sweep"))


def validated_levels(bars: DataFrame, n: int = 3, depth: int = 2, gap: int = 40, tol: float = 1.0, per_type: int = 3, acc: dict | None = None) -> DataFrame:
    """Leg retracement and extension prices that meet a live zone formed before the leg, best few per type."""
    from barloom.functions.scalar import fib_levels
    from barloom.session import cut

    zones = P.accumulation_zones(P.accumulation_flags(I.atr(bars, "seed_first"), **(acc or dict(lookback=8, atr_mult=1.2, band_pct=20.0, vol_sens=0.5, max_r2=0.6, min_flips=2))), 8, 10)
    legs = P.manipulation_legs(zones, P.swings(bars, n), depth, gap)
    pos = with_ordinal(bars, SYM, ["ts"], F.date_trunc("day", "ts")).select("symbol", F.col("ord").alias("pos"), "ts")
    legs = legs.join(pos, ["symbol", "pos"]).withColumnRenamed("ts", "leg_ts")
    lv = legs.select("symbol", "leg_ts", "leg", F.inline(fib_levels(F.least("price", "o_price"), F.greatest("price", "o_price"), "direction")))
    lv = cut(dedup_levels(lv, ["symbol", "leg_ts"], "price", [F.col("type"), F.col("value")]))
    live = P.zone_lifecycle(P.fvg_zones(bars).unionByName(P.order_block_zones(bars)), bars)
    way = F.col("direction").cast("int").alias("direction")
    z = live.select("symbol", way, F.col("ts").alias("z_ts"), "kind", "ended_ts", F.explode(F.array("near", (F.col("near") + F.col("far")) / 2, "far")).alias("z_level"))
    lv = lv.withColumn("direction", way)
    m = level_match(lv, z, [*SYM, "direction"], "price", "z_level", tol, "leg_ts", "z_ts", F.struct("z_ts", "kind", "z_level"), ["kind", "z_ts", "z_level"], ["symbol", "leg_ts", "type", "value"], "ended_ts", on_end=False)
    return top_n_per_group(m.where("kind is not null"), ["symbol", "leg_ts", "type"], [F.desc("leg"), F.col("value")], per_type)


@register_signal("level_engine")
def level_engine(bars: DataFrame, hours: int = 24, rr: float = 2.0, **kw) -> DataFrame:
    """Validated levels touched within a day of their leg, entered from the first later run zone (AFZ)."""
    from barloom.operators.joins import interval_join
    from barloom.session import cut

    lv = cut(validated_levels(bars, **kw)).withColumn("until", F.col("leg_ts") + F.expr(f"INTERVAL {hours} HOURS"))
    b = bars.select("symbol", F.col("ts").alias("b_ts"), F.col("high").alias("b_high"), F.col("low").alias("b_low"))
    touch = (F.col("b_ts") > F.col("leg_ts")) & (F.col("b_low") <= F.col("price")) & (F.col("b_high") >= F.col("price"))
    ident = ["symbol", "leg_ts", "type", "value", "direction"]
    hit = interval_join(lv, b, SYM, "leg_ts", "until", "b_ts", residual=touch).groupBy(*ident, "until").agg(F.min("b_ts").alias("touch_ts"))
    a = P.afz(bars).select("symbol", F.col("ts").alias("a_ts"), F.col("direction").alias("a_dir"), "entry", F.col("sl").alias("a_sl"))
    after = (F.col("a_dir") == F.col("direction")) & (F.col("a_ts") >= F.col("touch_ts"))
    e = interval_join(hit, a, SYM, "touch_ts", "until", "a_ts", residual=after).groupBy("symbol", "a_ts", "direction").agg(F.min_by(F.struct("entry", "a_sl"), "touch_ts").alias("x"))
    d = e.select("symbol", F.col("a_ts").alias("ts"), "direction", F.col("x.entry").alias("entry"), F.abs(F.col("x.entry") - F.col("x.a_sl")).alias("dist")).where("dist > 0")
    return emit(d.withColumnRenamed("direction", "__w"), F.col("__w"), F.col("entry"), F.col("dist"), rr, "level_engine")


@register_signal("every_n_bars")
def every_n_bars(bars: DataFrame, n: int = 20, stop: float = 10.0, rr: float = 2.0) -> DataFrame:
    d = with_ordinal(bars, SYM, ["ts"], F.date_trunc("day", "ts"))
    return emit(d.where(F.col("ord") % n == 0), F.when(F.col("ord") / n % 2 == 0, 1).otherwise(-1), F.col("close"), F.lit(stop), rr, "every_n")
