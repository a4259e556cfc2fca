"""Order fills and exits resolved on tables of entries and bars."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalar import round_to_tick
from barloom.operators.bars import SYM
from barloom.operators.joins import asof_join, interval_join, ordinal_join
from barloom.operators.scan import ROWS_TO_HERE
from barloom.operators.tiers import tiers


def exit_on_bar(sl: Column, tp: Column, bar: Callable[[str], Column] = lambda c: F.col(f"b_{c}")) -> tuple[Column, Column]:
    """(reason, price) of the exit a bar triggers: gapped stop, gapped target, stop, target."""
    o, h, l = bar("open"), bar("high"), bar("low")
    long = F.col("direction") == 1
    adverse_open = F.when(long, o <= sl).otherwise(o >= sl)
    good_open = F.when(long, o >= tp).otherwise(o <= tp)
    hit_sl = F.when(long, l <= sl).otherwise(h >= sl)
    hit_tp = F.when(long, h >= tp).otherwise(l <= tp)
    reason = F.when(adverse_open, "SL").when(good_open, "TP").when(hit_sl, "SL").when(hit_tp, "TP")
    price = (
        F.when(adverse_open, o).when(good_open, o)
        .when(hit_sl, F.when(long, F.least(o, sl)).otherwise(F.greatest(o, sl))).when(hit_tp, tp)
    )
    return reason, price


def _bar_columns(bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    return bars.select(*keys, F.col("ts").alias("b_ts"), *[F.col(c).alias(f"b_{c}") for c in ("open", "high", "low", "close")])


def first_touch_exit(entries: DataFrame, bars: DataFrame, keys: Sequence[str] = SYM) -> DataFrame:
    """Exit of each entry (ts, direction, sl_price, tp_price, end_ts): first bar after it that ends the trade.

    The bar is found through tiers of extremes, so a long trade reads no more rows than a short one; the bar that closes
    what nothing has ended is an as-of lookup. An entry whose window holds no bar keeps NULLs.
    """
    long, sl, tp = F.col("direction") == 1, F.col("sl_price"), F.col("tp_price")
    # An open outside the bar's range counts as well.
    wide = bars.withColumns({"__hi": F.greatest("high", "open"), "__lo": F.least("low", "open")})
    index = tiers(wide, keys, "__hi", "__lo", ["open", "high", "low", "close"])
    hit = index.first(entries, "ts", F.when(long, tp).otherwise(sl), F.when(long, sl).otherwise(tp), strict=False, out="__hit")
    last = bars.select(*keys, F.col("ts").alias("__bar"), F.col("ts").alias("__last"), F.col("close").alias("__close"))
    d = asof_join(hit, last, keys, "end_ts", "__bar", ["__last", "__close"])
    reason, price = exit_on_bar(sl, tp, lambda c: F.col(f"hit.{c}"))
    touched, closed = F.col("__hit") <= F.col("end_ts"), (F.col("__last") > F.col("ts")) & F.col("end_ts").isNotNull()
    return d.select(
        *entries.columns, F.when(touched, F.col("__hit")).when(closed, F.col("__last")).alias("exit_ts"),
        F.when(touched, price).when(closed, F.col("__close")).alias("exit_price"), F.when(touched, reason).when(closed, "EOD").alias("exit_reason"))


def same_bar_exit() -> tuple[Column, Column]:
    """(reason, price) on the bar a resting order fills: stop first, then target."""
    long, sl, tp = F.col("direction") == 1, F.col("sl_price"), F.col("tp_price")
    hit_sl = F.when(long, F.col("b_low") <= sl).otherwise(F.col("b_high") >= sl)
    hit_tp = F.when(long, F.col("b_high") >= tp).otherwise(F.col("b_low") <= tp)
    return F.when(hit_sl, "SAME_BAR_SL").when(hit_tp, "SAME_BAR_TP"), F.when(hit_sl, sl).when(hit_tp, tp)


def fill_on_bar() -> Column:
    """Fill price of a resting order on a bar, NULL without a fill."""
    long, kind = F.col("direction") == 1, F.col("order_type")
    lp, sp = round_to_tick("limit_price"), round_to_tick("stop_price")
    o, h, l = F.col("b_open"), F.col("b_high"), F.col("b_low")
    reaches_limit = F.when(long, l <= lp).otherwise(h >= lp)
    reaches_stop = F.when(long, h >= sp).otherwise(l <= sp)
    return (
        F.when((kind == "LIMIT") & reaches_limit, lp)
        .when((kind == "STOP") & reaches_stop, round_to_tick(F.when(long, F.greatest(o, sp)).otherwise(F.least(o, sp))))
        .when((kind == "STOP_LIMIT") & reaches_stop & reaches_limit, lp)
    )


def pending_fill(orders: DataFrame, bars: DataFrame, keys: Sequence[str] = SYM, ident: str = "entry_id", session_end: int | None = None) -> DataFrame:
    """First fill of each resting order within its expiry, unless its target is reached first.

    ``orders`` carry ``placed`` (row position of the signal bar) and ``expiry_bars``; ``bars`` carry ``ord``.
    The bar on which the countdown reaches zero no longer fills. A bar at or past the minute ``session_end`` cancels
    whatever still rests, before it can fill.
    """
    lp = F.col("limit_price")
    gone = (
        ((F.col("b_high") >= F.col("cancel_above")) & (F.col("b_low") > lp))
        | ((F.col("b_low") <= F.col("cancel_below")) & (F.col("b_high") < lp))
    )
    if session_end is not None:
        gone = (F.hour("b_ts") * 60 + F.minute("b_ts") >= session_end) | gone
    o = orders.withColumns({"__lo": F.col("placed") + 1, "__hi": F.col("placed") + F.col("expiry_bars") - 1}).where(F.col("__hi") >= F.col("__lo"))
    b = bars.select(*keys, F.col("ord").alias("b_ord"), F.col("ts").alias("b_ts"), *[F.col(c).alias(f"b_{c}") for c in ("open", "high", "low")])
    pairs = ordinal_join(o, b, keys, "__lo", "__hi", "b_ord")
    pairs = pairs.withColumns({"__cancel": F.coalesce(gone, F.lit(False)), "__price": fill_on_bar()}).where(F.col("__cancel") | F.col("__price").isNotNull())
    reason, price = same_bar_exit()
    event = F.struct("__cancel", "__price", "b_ts", reason.alias("reason"), price.alias("price"))
    first = pairs.groupBy(ident).agg(F.min_by(event, "b_ord").alias("__x"))
    filled = ~F.col("__x.__cancel")
    d = orders.join(first, ident, "left")
    return d.select(
        *orders.columns, F.when(filled, F.col("__x.b_ts")).alias("fill_ts"), F.when(filled, F.col("__x.__price")).alias("fill_price"),
        F.when(F.col("__x").isNull(), "EXPIRED").when(filled, "FILLED").otherwise("CANCELLED").alias("status"),
        F.when(filled, F.col("__x.reason")).alias("same_bar_reason"), F.when(filled, F.col("__x.price")).alias("same_bar_price"))


def apply_updates(updates: DataFrame) -> DataFrame:
    """Outcome of one stop/target update: rejected, forced exit, or the new levels (stop only improves).

    Needs direction, sl_price, tp_price, new_sl, new_tp, price.
    """
    long, price = F.col("direction") == 1, F.col("price")
    sl, tp = round_to_tick("new_sl"), round_to_tick("new_tp")
    crossed = F.coalesce(F.when(long, sl >= tp).otherwise(sl <= tp), F.lit(False))
    sl_past = F.coalesce(F.when(long, sl >= price).otherwise(sl <= price), F.lit(False))
    tp_past = F.coalesce(F.when(long, tp <= price).otherwise(tp >= price), F.lit(False))
    better = F.when(long, F.greatest("sl_price", sl)).otherwise(F.least("sl_price", sl))
    action = F.when(crossed, "REJECTED").when(sl_past | tp_past, "FORCED_EXIT").otherwise("APPLIED")
    return updates.withColumn("action", action).withColumns({
        "sl_after": F.when(crossed | sl_past, F.col("sl_price")).otherwise(better),
        "tp_after": F.when(F.col("action") == "APPLIED", F.coalesce(tp, F.col("tp_price"))).otherwise(F.col("tp_price")),
        "exit_price": F.when(F.col("action") == "FORCED_EXIT", price),
    })


def trailing_stop_path(entries: DataFrame, bars: DataFrame, keys: Sequence[str] = SYM, ident: str = "entry_id", salts: int = 4) -> DataFrame:
    """Trailing stop after every bar of a trade: watermark, activation, favourable moves only.

    ``stop`` is the level valid for the next bar; ``stop_before`` the one this bar was tested against.
    """
    pairs = interval_join(entries, _bar_columns(bars, keys), keys, "ts", "end_ts", "b_ts", residual=F.col("b_ts") > F.col("ts"), salts=salts)
    long = F.col("direction") == 1
    w = Window.partitionBy(ident).orderBy("b_ts")
    best = F.when(long, F.max("b_high").over(w.rowsBetween(*ROWS_TO_HERE))).otherwise(F.min("b_low").over(w.rowsBetween(*ROWS_TO_HERE)))
    mark = F.when(long, F.greatest(best, F.col("entry_price"))).otherwise(F.least(best, F.col("entry_price")))
    d = pairs.withColumn("watermark", mark)
    active = F.abs(F.col("watermark") - F.col("entry_price")) >= F.coalesce(F.col("trail_activation_points"), F.lit(0.0))
    d = d.withColumn("stop", F.when(active, F.col("watermark") - F.col("direction") * F.col("trail_points")))
    return d.withColumn("stop_before", F.lag("stop").over(w))


def trailing_exit(path: DataFrame, ident: str = "entry_id") -> DataFrame:
    """First bar that trades through the stop set before it."""
    long, s = F.col("direction") == 1, F.col("stop_before")
    hit = F.when(long, F.col("b_low") <= s).otherwise(F.col("b_high") >= s)
    price = F.when(long, F.least("b_open", s)).otherwise(F.greatest("b_open", s))
    return path.where(hit).groupBy(ident).agg(F.min_by(F.struct(F.col("b_ts").alias("exit_ts"), price.alias("exit_price")), "b_ts").alias("__x")).select(ident, "__x.*")


BAR = ("ts", "open", "high", "low", "close")


def bar_chunks(bars: DataFrame, keys: Sequence[str] = SYM, size: int = 256, columns: Sequence[str] = BAR) -> DataFrame:
    """Bars with ``ord`` as arrays of at most ``size``, in order: one row per key and ``chunk`` of positions."""
    b = bars.select(*keys, F.floor(F.col("ord") / size).alias("chunk"), F.struct("ord", *columns).alias("__b"))
    return b.groupBy(*keys, "chunk").agg(F.sort_array(F.collect_list("__b")).alias("chunk_bars"))


def trade_window_pieces(trades: DataFrame, bars: DataFrame, pad: int, keys: Sequence[str] = SYM, ident: str = "trade_id", size: int = 256, columns: Sequence[str] = BAR) -> DataFrame:
    """OHLC arrays around each trade (entry_ord - pad .. exit_ord + pad) in pieces of at most ``size`` bars.

    ``columns``: of the bars that a window holds beside ``ord``; every one of them is shuffled with every window.

    A row per trade and chunk of bars: ``piece`` (the chunk), ``place`` (of its first bar in the window), ``window``,
    ``entry_index`` and ``exit_index`` (places in the whole window). However long a trade is, no row and no task holds
    more of it than a chunk, and a chunk travels to a trade as one row. Trades without bars give no row.
    """
    t = trades.withColumns({"__lo": F.greatest(F.lit(1), F.col("entry_ord") - pad), "__hi": F.col("exit_ord") + pad})
    t = t.select(*keys, ident, "entry_ord", "exit_ord", "__lo", "__hi", F.explode(F.sequence(F.floor(F.col("__lo") / size), F.floor(F.col("__hi") / size))).alias("chunk"))
    d = t.join(bar_chunks(bars, keys, size, columns), [*keys, "chunk"])
    first, last = F.element_at("chunk_bars", 1)["ord"], F.element_at("chunk_bars", -1)["ord"]
    d = d.withColumns({"__from": F.greatest("__lo", first), "__to": F.least("__hi", last)}).where("__from <= __to")
    window = F.slice("chunk_bars", (F.col("__from") - first + 1).cast("int"), (F.col("__to") - F.col("__from") + 1).cast("int"))
    return d.select(*keys, ident, F.col("chunk").alias("piece"), (F.col("__from") - F.col("__lo")).alias("place"), window.alias("window"),
                    (F.col("entry_ord") - F.col("__lo")).alias("entry_index"), (F.col("exit_ord") - F.col("__lo")).alias("exit_index"))


def trade_windows(trades: DataFrame, bars: DataFrame, pad: int, keys: Sequence[str] = SYM, ident: str = "trade_id", columns: Sequence[str] = BAR) -> DataFrame:
    """The pieces of each trade as one array, in bar order; for trades of any length use ``trade_window_pieces``."""
    d = trade_window_pieces(trades, bars, pad, keys, ident, columns=columns)
    pieces = F.sort_array(F.collect_list(F.struct("place", "window")))
    return d.groupBy(ident).agg(F.flatten(F.transform(pieces, lambda p: p["window"])).alias("window"), F.first("entry_index").alias("entry_index"), F.first("exit_index").alias("exit_index"))
