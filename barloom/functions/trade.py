"""Column expressions over trades and entries."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalar import col

POINT_VALUE = 20.0
MICRO_POINT_VALUE = 2.0
MINI_ROUND_TRIP = 3.50
MICRO_ROUND_TRIP = 1.00
RISK_EPS = 1e-9
# Exit reasons and what each becomes when the trade is reversed.
REVERSED_REASON = {"SL": "TP", "TP": "SL", "SAME_BAR_SL": "SAME_BAR_TP", "SAME_BAR_TP": "SAME_BAR_SL"}


def with_trade_pnl(df: DataFrame, point_value: float = POINT_VALUE) -> DataFrame:
    """All derived profit, cost and R columns of a trade."""
    d = F.col("direction")
    points = (F.col("exit_price") - F.col("entry_price")) * d
    risk = F.abs(F.col("entry_price") - F.col("initial_sl_price"))
    scaled = lambda x: F.when(risk > RISK_EPS, x / risk)
    out = df.withColumns({
        "pnl_points": points,
        "pnl_dollars": points * F.col("contracts") * point_value,
        "slippage_paid": 2 * F.col("slippage_points") * F.col("contracts") * point_value,
        "commission_paid": 2 * F.col("commission_per_contract") * F.col("contracts"),
        "r_multiple": scaled(points),
        "mae_r": scaled(F.col("mae_points")),
        "mfe_r": scaled(F.col("mfe_points")),
    })
    out = out.withColumn("net_pnl_dollars", F.col("pnl_dollars") - F.col("slippage_paid") - F.col("commission_paid"))
    out = out.withColumn("is_winner", F.col("net_pnl_dollars") > 0)
    if "entry_bar" in df.columns:
        out = out.withColumn("bars_held", F.col("exit_bar") - F.col("entry_bar"))
    return out


def reverse_trades(df: DataFrame) -> DataFrame:
    """The same trades taken the other way round."""
    swap = F.col("exit_reason")
    lookup = F.create_map(*[F.lit(x) for kv in REVERSED_REASON.items() for x in kv])
    return df.withColumns({
        "direction": -F.col("direction"),
        "sl_price": F.col("tp_price"), "tp_price": F.col("sl_price"),
        "initial_sl_price": F.col("initial_tp_price"), "initial_tp_price": F.col("initial_sl_price"),
        "mae_points": F.col("mfe_points"), "mfe_points": F.col("mae_points"),
        "exit_reason": F.coalesce(F.element_at(lookup, swap), swap),
    })


def mirror_entries(df: DataFrame) -> DataFrame:
    """Reverse entries: flip direction, reflect stop and target around the order's own price."""
    anchor = F.coalesce(F.col("stop_price"), F.col("limit_price"))
    return df.withColumns({
        "direction": -F.col("direction"),
        "sl_price": 2 * anchor - F.col("sl_price"),
        "tp_price": 2 * anchor - F.col("tp_price"),
    })


def _distance(mode, size, base, risk, atr, range_size) -> Column:
    """Distance from the entry for the sizing modes stops and targets share."""
    m, v = col(mode), col(size)
    return (
        F.when(m == "range_pct", range_size * v / 100.0)
        .when(m == "atr_multiple", atr * v)
        .when(m == "fixed_pct", base * v / 100.0)
        .when(m == "fixed_points", v)
        .when(m == "risk_reward", risk * v)
    )


def stop_level(mode, entry, direction, size, atr, range_high, range_low) -> Column:
    """Stop by range share, ATR multiple, percent, points, or at the far side of the range."""
    e, d, hi, lo = col(entry), col(direction), col(range_high), col(range_low)
    away = _distance(mode, size, e, F.lit(None).cast("double"), col(atr), hi - lo)
    return F.when(col(mode) == "opposite_range", F.when(d == 1, lo).otherwise(hi)).otherwise(e - d * away)


def target_level(mode, entry, direction, size, sl, atr, range_high, range_low) -> Column:
    """Target by risk multiple, range share, ATR multiple, percent or points."""
    e = col(entry)
    return e + col(direction) * _distance(mode, size, e, F.abs(e - col(sl)), col(atr), col(range_high) - col(range_low))


def contracts_for(size_type, size_value, sl_points, balance) -> Column:
    """Whole contracts: a fixed number, dollars at risk, or a share of the balance at risk (at least 1)."""
    per = F.nullif(col(sl_points) * POINT_VALUE, F.lit(0.0))
    money = F.when(col(size_type) == "DOLLARS", col(size_value)).otherwise(col(balance) * col(size_value))
    return F.when(col(size_type) == "CONTRACTS", col(size_value).cast("int")).otherwise(F.greatest(F.lit(1), F.floor(money / per))).cast("int")


def sized_pnl(points, sl_distance, risk, max_minis, max_micros) -> dict[str, Column]:
    """Minis while one mini fits the risk, else micros, within the caps; profit net of commission."""
    sl, r = F.greatest(F.lit(0.25), col(sl_distance)), col(risk)
    mini = (col(max_minis) > 0) & (sl * POINT_VALUE <= r)
    value = F.when(mini, POINT_VALUE).otherwise(MICRO_POINT_VALUE)
    cap = F.when(mini, col(max_minis)).otherwise(col(max_micros))
    n = F.least(F.greatest(F.floor(r / (sl * value)), F.lit(1)), cap)
    fee = F.when(mini, MINI_ROUND_TRIP).otherwise(MICRO_ROUND_TRIP)
    return {"use_mini": mini, "contracts": n.cast("int"), "net_pnl": n * (col(points) * value - fee)}


def target_risk(scheme, risk_pct, balance, floor_level, start_balance, max_drawdown, won_last, prior_risk) -> Column:
    """Dollars to risk on the next trade; the base is a share of the account's allowed drawdown."""
    base = col(risk_pct) * col(max_drawdown)
    left = F.greatest(F.lit(1.0), col(balance) - col(floor_level))
    return (
        F.when(col(scheme) == "pct_balance", col(balance) * base / col(start_balance))
        .when(col(scheme) == "frac_dd", left * col(risk_pct))
        .when(col(scheme) == "floor_aware", base * F.least(F.lit(2.0), F.greatest(F.lit(0.25), 2.0 * left / col(max_drawdown))))
        .when(col(scheme) == "max_size", F.lit(1e9))
        .when(col(scheme) == "martingale", F.when(col(won_last), base).otherwise(F.least(2 * col(prior_risk), 4 * base)))
        .otherwise(base)
    )


def winning_day_size(win_points, sl_points, threshold, max_micros, trades_per_day: float = 1.0) -> dict[str, Column]:
    """Smallest single-instrument size whose expected winning day clears the threshold, least risk first."""
    sl = col(sl_points)

    def option(value: float, fee: float, cap: Column) -> tuple[Column, Column]:
        net = col(win_points) * value - fee * trades_per_day
        n = F.when(net > 0, F.least(F.greatest(F.ceil(col(threshold) / F.nullif(net, F.lit(0.0))), F.lit(1)), cap)).otherwise(cap)
        return n, F.when(net > 0, n * sl * value)

    minis, mini_risk = option(POINT_VALUE, MINI_ROUND_TRIP, F.floor(col(max_micros) / 10))
    micros, micro_risk = option(MICRO_POINT_VALUE, MICRO_ROUND_TRIP, col(max_micros).cast("bigint"))
    usable = (col(win_points) > 0) & (sl > 0)
    micro_first = mini_risk.isNull() | F.coalesce(micro_risk <= mini_risk, F.lit(False))
    return {
        "minis": F.when(usable & ~micro_first, minis).otherwise(0),
        "micros": F.when(usable & micro_first, micros).otherwise(0),
        "day_risk": F.when(usable, F.coalesce(F.when(micro_first, micro_risk).otherwise(mini_risk), F.lit(0.0))).otherwise(0.0),
    }


def normalised(df: DataFrame) -> DataFrame:
    """Signed points and stop distance; a trade without a stop uses its adverse move, at least one tick."""
    sl = F.abs(F.col("entry_price") - F.col("initial_sl_price"))
    return df.withColumns({
        "signed_points": (F.col("exit_price") - F.col("entry_price")) * F.col("direction"),
        "sl_distance": F.greatest(F.coalesce(sl, F.abs(F.col("mae_points"))), F.lit(0.25)),
    })


def loss_penalty(r, factor: float = 1.5) -> Column:
    return F.when(col(r) > 0, col(r)).otherwise(col(r) * factor)


def position_delta(df: DataFrame, w) -> DataFrame:
    """Contracts to close and to open when a signed target position replaces the current one."""
    cur = F.coalesce(F.lag("target").over(w), F.lit(0.0))
    t = F.col("target")
    flip = F.signum(cur) * F.signum(t) < 0
    return df.withColumn("current", cur).withColumns({
        "close_contracts": F.when(flip, F.abs(cur)).otherwise(F.greatest(F.abs(cur) - F.abs(t), F.lit(0.0))),
        "open_contracts": F.greatest(F.abs(t) - F.abs(cur), F.lit(0.0)),
    })


def violations(*rules: tuple[str, Column]) -> Column:
    """Names of the broken rules of a row."""
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules]))


def order_violations() -> Column:
    d, sl, tp = F.col("direction"), F.col("sl_price"), F.col("tp_price")
    ref = F.coalesce(F.col("limit_price"), F.col("stop_price"), F.col("ref_price"))
    kind, size_type, v = F.col("order_type"), F.col("size_type"), F.col("size_value")
    return violations(
        ("direction_not_unit", ~d.isin(1, -1)),
        ("size_not_positive", v <= 0),
        ("stop_and_trail", sl.isNotNull() & F.col("trail_points").isNotNull()),
        ("risk_size_without_stop", (size_type != "CONTRACTS") & sl.isNull() & F.col("trail_points").isNull()),
        ("limit_price_missing", kind.isin("LIMIT", "STOP_LIMIT") & F.col("limit_price").isNull()),
        ("stop_price_missing", kind.isin("STOP", "STOP_LIMIT") & F.col("stop_price").isNull()),
        ("pct_out_of_range", (size_type == "PCT_RISK") & ((v <= 0) | (v > 1))),
        ("contracts_not_whole", (size_type == "CONTRACTS") & (v != F.floor(v))),
        ("stop_wrong_side", (sl - ref) * d >= 0),
        ("target_wrong_side", (tp - ref) * d <= 0),
        ("stop_equals_target", sl == tp),
        ("trail_not_positive", F.col("trail_points") <= 0),
        ("activation_without_trail", F.col("trail_activation_points").isNotNull() & F.col("trail_points").isNull()),
        ("activation_negative", F.col("trail_points").isNotNull() & (F.col("trail_activation_points") < 0)),
        ("limit_wrong_side", (kind == "LIMIT") & ((F.col("limit_price") - F.col("ref_price")) * d > 0)),
    )


def update_violations() -> Column:
    return violations(("stop_crosses_target", (F.col("direction") * (F.col("tp_price") - F.col("sl_price"))) <= 0))
