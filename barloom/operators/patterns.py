"""Price patterns: pivots, zones and their lives, structure breaks, runs of candles."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalar import STDV_MULTIPLES, round_down, round_up
from barloom.operators.bars import SYM
from barloom.operators.joins import interval_join
from barloom.operators.scan import framed, prefix
from barloom.operators.tiers import Tiers, tiers
from barloom.session import cut


def candle_shape(bars: DataFrame) -> DataFrame:
    """Body, wicks, close position and marubozu/doji flags of each candle."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    rng = h - l
    return bars.withColumns({
        "body": F.abs(c - o), "upper_wick": h - F.greatest(o, c), "lower_wick": F.least(o, c) - l, "colour": F.signum(c - o).cast("int"),
        "bull_pos": F.when(h - o > 0, (c - o) / F.nullif(h - o, F.lit(0.0))).otherwise(0.0), "bear_pos": F.when(o - l > 0, (o - c) / F.nullif(o - l, F.lit(0.0))).otherwise(0.0),
        "wick_ratio": (h - F.greatest(o, c) + F.least(o, c) - l) / F.when(rng > 0, rng).otherwise(0.01), "doji": F.abs(c - o) < 0.1 * rng})


def swings(bars: DataFrame, n: int, keys: Sequence[str] = SYM) -> DataFrame:
    """Strict n-bar pivots with the bar that confirms them: (kind, price, ts, confirmed_ts, ord)."""
    def add(d, w):
        left, right = w.rowsBetween(-n, -1), w.rowsBetween(1, n)
        full = (F.count(F.lit(1)).over(left) == n) & (F.count(F.lit(1)).over(right) == n)
        top = full & (F.col("high") > F.max("high").over(left)) & (F.col("high") > F.max("high").over(right))
        low = full & (F.col("low") < F.min("low").over(left)) & (F.col("low") < F.min("low").over(right))
        return d.withColumns({
            "__s": F.array_compact(F.array(F.when(top, F.struct(F.lit("H").alias("kind"), F.col("high").alias("price"))), F.when(low, F.struct(F.lit("L").alias("kind"), F.col("low").alias("price"))))),
            "confirmed_ts": F.lead("ts", n).over(w), "pos": F.col("ord")})

    d = framed(bars, keys, ["ts"], add, before=n, after=n)
    return d.select(*keys, "ts", "confirmed_ts", "pos", F.explode("__s").alias("__p")).select(*keys, "ts", "confirmed_ts", "pos", "__p.*")


def fvg_zones(bars: DataFrame, keys: Sequence[str] = SYM) -> DataFrame:
    """Three-bar gaps as zones (direction, near, far)."""
    def add(d, w):
        h2, l2 = F.lag("high", 2).over(w), F.lag("low", 2).over(w)
        return d.withColumn("__z", F.when(h2 < F.col("low"), F.struct(F.lit(1).alias("direction"), h2.alias("near"), F.col("low").alias("far")))
                            .when(l2 > F.col("high"), F.struct(F.lit(-1).alias("direction"), l2.alias("near"), F.col("high").alias("far"))))

    d = framed(bars, keys, ["ts"], add, before=2).where("__z is not null")
    return d.select(*keys, F.lit("FVG").alias("kind"), "ts", "__z.*")


def order_block_zones(bars: DataFrame, keys: Sequence[str] = SYM) -> DataFrame:
    """An opposite candle closed through by the next one: its body is the zone."""
    def add(d, w):
        po, pc, ph, pl = (F.lag(x).over(w) for x in ("open", "close", "high", "low"))
        top, bot = F.greatest(po, pc), F.least(po, pc)
        up = (pc < po) & (F.col("close") > F.col("open")) & (F.col("close") > ph)
        down = (pc > po) & (F.col("close") < F.col("open")) & (F.col("close") < pl)
        return d.withColumn("__z", F.when(up, F.struct(F.lit(1).alias("direction"), top.alias("near"), bot.alias("far")))
                            .when(down, F.struct(F.lit(-1).alias("direction"), bot.alias("near"), top.alias("far"))))

    d = framed(bars, keys, ["ts"], add, before=1).where("__z is not null")
    return d.select(*keys, F.lit("OB").alias("kind"), "ts", "__z.*")


def first_crossing(levels: DataFrame, index: Tiers, after: str, level: str, side: str, strict: bool = True, from_here: bool = False, out: str = "cross_ts") -> DataFrame:
    """``levels`` with the first bar after ``after`` whose indexed value lies beyond ``level`` (side column: 1 above, -1 below).

    ``from_here`` also admits the bar at ``after`` itself.
    """
    up = F.col(side) == 1
    return index.first(levels, after, F.when(up, F.col(level)), F.when(~up, F.col(level)), strict, from_here, out).drop("hit")


def zone_lifecycle(zones: DataFrame, bars: DataFrame, keys: Sequence[str] = SYM) -> DataFrame:
    """Zones with the bar that ends them, and the flipped zones they turn into.

    An order block is closed through at its far edge and returns as a breaker, which ends at its near edge.
    A gap is closed through at its near edge and returns inverted, which ends at its far edge.
    """
    closes = tiers(bars, keys, "close", "close")
    first_edge = F.when(F.col("kind") == "OB", F.col("far")).otherwise(F.col("near"))
    z = zones.withColumns({"__edge": first_edge, "__side": -F.col("direction")})
    z = cut(first_crossing(z, closes, "ts", "__edge", "__side", out="ended_ts").drop("__edge", "__side"))
    flipped = z.where(F.col("ended_ts").isNotNull()).select(
        *keys, F.when(F.col("kind") == "OB", "BB").otherwise("IFVG").alias("kind"), F.col("ended_ts").alias("ts"), (-F.col("direction")).alias("direction"), "near", "far", F.col("ts").alias("origin_ts"))
    second_edge = F.when(F.col("kind") == "BB", F.col("near")).otherwise(F.col("far"))
    f = flipped.withColumns({"__edge": second_edge, "__side": -F.col("direction")})
    f = first_crossing(f, closes, "ts", "__edge", "__side", out="ended_ts").drop("__edge", "__side")
    return z.withColumn("origin_ts", F.col("ts")).unionByName(f)


def rejection_zones(gaps: DataFrame, bars: DataFrame, min_wick: float, keys: Sequence[str] = SYM) -> DataFrame:
    """Wicks that reach into a live gap: (wick tip, wick base), ended once price trades to their middle.

    Only days whose lows (or highs) reach the gap are opened.
    """
    keys = list(keys)
    b = bars.select(*keys, F.col("ts").alias("b_ts"), F.to_date("ts").alias("__d"), "open", "high", "low", "close")
    days = b.groupBy(*keys, "__d").agg(F.min("low").alias("__l0"), F.max("low").alias("__l1"), F.min("high").alias("__h0"), F.max("high").alias("__h1"))
    last = days.groupBy(*keys).agg(F.max("__d").alias("__last"))
    g = gaps.join(last, keys).withColumn("__d", F.explode(F.sequence(F.to_date("ts"), F.coalesce(F.to_date("ended_ts"), F.col("__last")))))
    lo, hi = F.least("near", "far"), F.greatest("near", "far")
    reach = F.when(F.col("direction") == 1, (F.col("__l0") <= hi) & (F.col("__l1") >= lo)).otherwise((F.col("__h0") <= hi) & (F.col("__h1") >= lo))
    live = g.join(days, [*keys, "__d"]).where(reach).select(*keys, "__d", F.col("ts").alias("gap_ts"), "ended_ts", "direction", "near", "far")
    d = live.join(b, [*keys, "__d"]).where((F.col("b_ts") > F.col("gap_ts")) & (F.col("ended_ts").isNull() | (F.col("b_ts") < F.col("ended_ts"))))
    tip = F.when(F.col("direction") == 1, F.col("low")).otherwise(F.col("high"))
    base = F.when(F.col("direction") == 1, F.least("open", "close")).otherwise(F.greatest("open", "close"))
    body = F.abs(F.col("close") - F.col("open"))
    d = d.withColumns({"wick_tip": tip, "wick_base": base}).where(F.col("wick_tip").between(lo, hi) & (body > 1e-9) & (F.abs(base - tip) > min_wick * body))
    rb = d.select(*keys, F.lit("RB").alias("kind"), F.col("b_ts").alias("ts"), "gap_ts", "direction", F.col("wick_tip").alias("near"), F.col("wick_base").alias("far"), "wick_tip", "wick_base", ((F.col("wick_tip") + F.col("wick_base")) / 2).alias("mid"))
    up = F.col("direction") == -1
    found = tiers(bars, keys).first(rb, "ts", F.when(up, F.col("mid")), F.when(~up, F.col("mid")), strict=False, out="ended_ts")
    return found.drop("hit")


def break_of_structure(bars: DataFrame, n: int, keys: Sequence[str] = SYM) -> DataFrame:
    """Swings closed through before a higher (lower) swing replaced them: (kind, price, ts, bos_ts)."""
    s = swings(bars, n, keys).where(F.col("confirmed_ts").isNotNull()).withColumn("__side", F.when(F.col("kind") == "H", 1).otherwise(-1))
    d = first_crossing(s, tiers(bars, keys, "close", "close"), "confirmed_ts", "price", "__side", from_here=True, out="bos_ts")
    marks = s.select(*keys, "kind", F.col("confirmed_ts").alias("ts"), "price")
    d = first_crossing(d, tiers(marks, [*keys, "kind"], "price", "price"), "confirmed_ts", "price", "__side", out="replaced_ts")
    alive = F.col("bos_ts").isNotNull() & (F.col("replaced_ts").isNull() | (F.col("bos_ts") < F.col("replaced_ts")))
    return d.where(alive).drop("__side", "replaced_ts", "pos")


def candle_runs(bars: DataFrame, keys: Sequence[str] = SYM, body_ratio: float = 0.0) -> DataFrame:
    """Runs of same-coloured candles: number, start open and length so far on every bar.

    With ``body_ratio`` a run also breaks where a body is less than that share of the next one.
    """
    colour, body = F.signum(F.col("close") - F.col("open")), F.abs(F.col("close") - F.col("open"))

    def mark(d, w):
        d = d.withColumns({"colour": colour.cast("int"), "__body": body})
        new = F.lag("colour").over(w).isNull() | (F.lag("colour").over(w) != F.col("colour")) | (F.lag("__body").over(w) < body_ratio * F.col("__body"))
        return d.withColumns({"__new": new, "__o": F.col("ord")})

    d = framed(bars, keys, ["ts"], mark, before=1)
    start = F.when(F.col("__new"), F.struct(F.col("__o").alias("o"), F.col("open").alias("open")))
    d = prefix(d, keys, ["ts"], {"run": ("sum", F.when(F.col("__new"), 1).otherwise(0)), "__start": ("last", start)})
    return d.withColumns({"run_open": F.col("__start.open"), "run_len": F.col("__o") - F.col("__start.o") + 1}).drop("__new", "__o", "__body", "__start")


def cisd(bars: DataFrame, min_series: int, body_ratio: float, keys: Sequence[str] = SYM) -> DataFrame:
    """Bars that trade back through the open of the opposite run just before them (1 up, -1 down)."""
    d = candle_runs(bars, keys, body_ratio)

    def check(x, w):
        colour, length, level = (F.lag(c).over(w) for c in ("colour", "run_len", "run_open"))
        up = (colour == -1) & (length >= min_series) & (F.greatest("open", "close") > level)
        down = (colour == 1) & (length >= min_series) & (F.least("open", "close") < level)
        return x.withColumns({"cisd": F.when(up, 1).when(down, -1).otherwise(0), "cisd_level": level})

    return framed(d, keys, ["ts"], check, before=1).where(F.col("cisd") != 0)


def afz(bars: DataFrame, keys: Sequence[str] = SYM) -> DataFrame:
    """Zone of the opposite run before a bar's own run: top, bottom, extreme, entry and stop.

    Only neighbouring runs are paired; minima over the zone combine a suffix of the earlier run with a
    prefix of the bar's own run.
    """
    keys = list(keys)
    d = candle_runs(bars, keys).where(F.col("colour") != 0)
    part = Window.partitionBy(*keys, "run").orderBy("ts")
    so_far, to_end = part.rowsBetween(Window.unboundedPreceding, 0), part.rowsBetween(0, Window.unboundedFollowing)
    bot, top = F.least("open", "close"), F.greatest("open", "close")
    own = d.select(*keys, F.col("ts"), "run", "colour", F.col("close").alias("c"), F.min(bot).over(so_far).alias("b0"), F.max(top).over(so_far).alias("t0"), F.min("low").over(so_far).alias("l0"), F.max("high").over(so_far).alias("h0"))
    prior = d.select(*keys, (F.col("run") + 1).alias("run"), (-F.col("colour")).alias("colour"), F.col("ts").alias("p_ts"), F.col("open").alias("po"), F.col("high").alias("ph"), F.col("low").alias("pl"),
                     F.min(bot).over(to_end).alias("b1"), F.max(top).over(to_end).alias("t1"), F.min("low").over(to_end).alias("l1"), F.max("high").over(to_end).alias("h1"))
    m = own.join(prior, [*keys, "run", "colour"])
    long = F.col("colour") == 1
    inside = F.when(long, F.col("c") >= F.col("po")).otherwise(F.col("c") <= F.col("po"))
    edge = F.when(long, F.when(F.col("c") >= F.col("ph"), F.col("ph")).otherwise(F.col("po"))).otherwise(-F.when(F.col("c") <= F.col("pl"), F.col("pl")).otherwise(F.col("po")))
    pick = F.max_by(F.struct(edge.alias("edge"), "p_ts", "b1", "t1", "l1", "h1"), F.struct(edge.alias("e"), F.col("p_ts")))
    g = m.where(inside).groupBy(*keys, "ts", "colour", "b0", "t0", "l0", "h0").agg(pick.alias("z"))
    zone_top = F.when(F.col("colour") == 1, F.col("z.edge")).otherwise(F.greatest("t0", "z.t1"))
    zone_bot = F.when(F.col("colour") == 1, F.least("b0", "z.b1")).otherwise(-F.col("z.edge"))
    extreme = F.when(F.col("colour") == 1, F.least("l0", "z.l1")).otherwise(F.greatest("h0", "z.h1"))
    g = g.select(*keys, "ts", F.col("colour").alias("direction"), zone_top.alias("zone_top"), zone_bot.alias("zone_bot"), extreme.alias("extreme"), F.col("z.p_ts").alias("from_ts"))
    mid, up = (F.col("zone_top") + F.col("zone_bot")) / 2.0, F.col("direction") == 1
    return g.withColumns({
        "entry": F.when(up, round_up(mid)).otherwise(round_down(mid)),
        "sl": F.when(up, round_down(F.col("zone_bot") - (F.col("zone_bot") - F.col("extreme")) / 2.0)).otherwise(round_up(F.col("zone_top") + (F.col("extreme") - F.col("zone_top")) / 2.0))})


def accumulation_flags(bars: DataFrame, lookback: int, atr_mult: float, band_pct: float, vol_sens: float, max_r2: float, min_flips: int, keys: Sequence[str] = SYM) -> DataFrame:
    """Quiet bars: low ATR share, tight band, no trend and many direction changes over the bars before.

    Needs an ``atr`` column. ``win_high``/``win_low`` are the extremes of the window.
    """
    def add(d, w):
        f = w.rowsBetween(-lookback, -1)
        ok = F.count(F.lit(1)).over(f) == lookback
        d = d.withColumn("__pct", F.col("atr") / F.col("close") * 100.0)
        d = d.withColumn("__dir", F.signum(F.col("close") - F.lag("close").over(w)))
        d = d.withColumn("__flip", (F.col("__dir") != F.lag("__dir").over(w)).cast("int"))
        hi, lo = F.max("high").over(f), F.min("low").over(f)
        quiet = F.col("__pct") < atr_mult * F.avg("__pct").over(f)
        avg_atr = F.avg("atr").over(f)
        band = F.when(avg_atr > 1e-9, band_pct * F.pow(F.col("atr") / F.nullif(avg_atr, F.lit(0.0)), F.lit(vol_sens))).otherwise(band_pct)
        tight = (hi - lo) / F.greatest(F.col("close"), F.lit(1e-9)) < band
        spread = F.var_pop("close").over(f)
        r2 = F.when(spread * lookback < 1e-10, 0.0).otherwise(F.regr_r2("close", F.col("ord").cast("double")).over(f))
        flips = F.sum("__flip").over(w.rowsBetween(-lookback + 2, -1))
        return d.withColumns({"accum": F.coalesce(ok & quiet & tight & (r2 < max_r2) & (flips >= min_flips), F.lit(False)), "win_high": hi, "win_low": lo, "pos": F.col("ord")}).drop("__pct", "__dir", "__flip")

    return framed(bars, keys, ["ts"], add, before=lookback + 2)


def accumulation_zones(flags: DataFrame, lookback: int, min_bars: int, keys: Sequence[str] = SYM) -> DataFrame:
    """Runs of quiet bars as zones reaching back over the first window."""
    d = prefix(flags, keys, ["ts"], {"__run": ("count", F.when(~F.col("accum"), 1))})
    z = d.where("accum").groupBy(*keys, "__run").agg(F.min("pos").alias("__p0"), F.max("pos").alias("end_pos"), F.max("ts").alias("end_ts"), F.max("win_high").alias("high"), F.min("win_low").alias("low"))
    z = z.withColumn("start_pos", F.col("__p0") - lookback)
    return z.where(F.col("end_pos") + 1 - F.col("start_pos") >= min_bars).drop("__run", "__p0")


def merge_overlapping_zones(zones: DataFrame, max_gap: int, keys: Sequence[str] = SYM) -> DataFrame:
    """Merge consecutive zones of a day that are close and overlap in price (running merged bounds)."""
    day = [*keys, "date"]
    item = F.struct(F.col("start_pos").cast("long").alias("s"), F.col("end_pos").cast("long").alias("e"), F.col("high").cast("double").alias("h"), F.col("low").cast("double").alias("l"))
    g = zones.groupBy(*day).agg(F.array_sort(F.collect_list(item)).alias("__z"))

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"), F.greatest(last["h"], x["h"]).alias("h"), F.least(last["l"], x["l"]).alias("l"))
        near = (x["s"] - last["e"] <= max_gap) & (x["l"] <= last["h"]) & (x["h"] >= last["l"])
        return F.when(near, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    first = F.slice("__z", 1, 1)
    merged = F.aggregate(F.slice("__z", F.lit(2), F.size("__z")), first, step)
    out = g.select(*day, F.explode(merged).alias("m"))
    return out.select(*day, F.col("m.s").alias("start_pos"), F.col("m.e").alias("end_pos"), F.col("m.h").alias("high"), F.col("m.l").alias("low"))


def manipulation_legs(zones: DataFrame, pivots: DataFrame, depth: int, max_gap: int, keys: Sequence[str] = SYM) -> DataFrame:
    """Largest leg after each zone: a swing within the gap limit and its depth-th prior opposite swing."""
    keys = list(keys)
    s = pivots.select(*keys, "kind", "price", "pos")
    p = prefix(s, keys, ["pos", "kind"], {"__nh": ("count", F.when(F.col("kind") == "H", 1)), "__nl": ("count", F.when(F.col("kind") == "L", 1))}, F.floor(F.col("pos") / 4096))
    numbered = p.withColumn("k", F.when(F.col("kind") == "H", F.col("__nh")).otherwise(F.col("__nl"))).select(*keys, F.col("kind").alias("o_kind"), "k", F.col("price").alias("o_price"), F.col("pos").alias("o_pos"))
    same_bar = s.groupBy(*keys, "pos").agg(F.count(F.lit(1)).alias("__c"))
    p = p.join(same_bar, [*keys, "pos"]).withColumn("o_kind", F.when(F.col("kind") == "H", "L").otherwise("H"))
    before = F.when(F.col("kind") == "H", F.col("__nl")).otherwise(F.col("__nh") - F.when((F.col("kind") == "L") & (F.col("__c") == 2), 1).otherwise(0))
    legs = p.withColumn("k", before - (depth - 1)).join(numbered, [*keys, "o_kind", "k"]).select(*keys, "kind", "pos", "price", "o_price", "o_pos", F.abs(F.col("price") - F.col("o_price")).alias("leg"))
    size = 256
    z = zones.withColumns({"__lo": F.col("end_pos") + 1, "__hi": F.col("end_pos") + max_gap})
    z = z.withColumn("__b", F.explode(F.sequence(F.floor(F.col("__lo") / size), F.floor(F.col("__hi") / size))))
    m = z.join(legs.withColumn("__b", F.floor(F.col("pos") / size)), [*keys, "__b"]).where(F.col("pos").between(F.col("__lo"), F.col("__hi")))
    best = m.groupBy(*keys, "end_pos").agg(F.max_by(F.struct("kind", "pos", "price", "o_price", "o_pos", "leg"), F.struct("leg", -F.col("pos"))).alias("__x"))
    return best.select(*keys, "end_pos", "__x.*").withColumn("direction", F.when(F.col("kind") == "H", 1).otherwise(-1))


def untouched_levels(levels: DataFrame, bars: DataFrame, keys: Sequence[str], ident: Sequence[str], start: str, end: str, price: str, salts: int = 4) -> DataFrame:
    """Levels no bar has traded at between ``start`` (exclusive) and ``end``."""
    b = bars.select(*keys, F.col("ts").alias("b_ts"), F.col("high").alias("b_high"), F.col("low").alias("b_low"))
    hit = (F.col("b_ts") > F.col(start)) & (F.col("b_low") <= F.col(price)) & (F.col("b_high") >= F.col(price))
    touched = interval_join(levels, b, keys, start, end, "b_ts", residual=hit, salts=salts).select(*ident).distinct()
    return levels.join(touched, list(ident), "left_anti")


def confluence_targets(signals: DataFrame, pivots_by_day: DataFrame, min_rr: float, tol: float, keys: Sequence[str] = SYM) -> DataFrame:
    """Extension targets of a zone meeting the minimum reward, flagged where a day's swing lies within tol."""
    up = F.col("direction") == 1
    rng = F.when(up, F.col("zone_top") - F.col("extreme")).otherwise(F.col("extreme") - F.col("zone_bot"))
    base = F.when(up, F.col("zone_top")).otherwise(F.col("zone_bot"))
    risk = F.abs(F.col("entry") - F.col("sl"))
    d = signals.join(pivots_by_day, [*keys, "date"], "left").withColumns({"__rng": rng, "__risk": risk})
    price = F.explode(F.array(*[base + F.col("direction") * m * F.col("__rng") for m in STDV_MULTIPLES]))
    d = d.where((F.col("__rng") > 0) & (F.col("__risk") >= 1e-9)).withColumn("target", price).where(F.abs(F.col("target") - F.col("entry")) / F.col("__risk") >= min_rr)
    near = lambda arr: F.exists(F.coalesce(F.col(arr), F.array().cast("array<double>")), lambda x: F.abs(x - F.col("target")) <= tol)
    return d.withColumn("confluent", F.when(up, near("swing_lows")).otherwise(near("swing_highs"))).drop("__rng", "__risk", "swing_lows", "swing_highs")


def pivots_by_day(pivots: DataFrame, keys: Sequence[str] = SYM) -> DataFrame:
    """Swing prices of each day as two arrays (at most one pivot pair per bar of the day)."""
    price = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("price"))))
    return pivots.groupBy(*keys, F.to_date("ts").alias("date")).agg(price("H").alias("swing_highs"), price("L").alias("swing_lows"))

