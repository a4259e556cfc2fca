"""Rules whose next decision depends on the trades already taken."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from barloom.functions.trade import POINT_VALUE
from barloom.operators.scan import ordered_walk

# Account fees (first evaluation, reset).
FEES = {"25K": (70.0, 60.0), "50K": (98.0, 105.0), "100K": (157.5, 140.0), "150K": (294.0, 225.0)}


def dynamic_sizing(trades: DataFrame, runs: Sequence[str], order: Sequence[str], capital: float, risk: float, slippage: float = 0.0, commission: float = 0.0) -> DataFrame:
    """Contracts from the equity each closed trade leaves; needs points and sl_distance."""
    def fresh():
        return {"equity": float(capital)}

    def step(s, row):
        n = max(1, int(s["equity"] * risk / (max(row.sl_distance, 1e-9) * POINT_VALUE)))
        net = n * (row.points * POINT_VALUE - 2 * slippage * POINT_VALUE - 2 * commission)
        s["equity"] += net
        return n, net, s["equity"]

    return ordered_walk(trades, runs, order, fresh, step, "contracts long, net double, equity double")


def session_pnl_gate(trades: DataFrame, sessions: Sequence[str], max_trades: int, stop_if_positive: bool, entry: str = "entry_ts", exit: str = "exit_ts", ident: str = "trade_id") -> DataFrame:
    """Which signals of a session occurrence would be traded: none past the count, none once the session is up.

    A signal knows only what has closed by its own time: of the trades taken before it, those whose exit is not later
    than its entry. Still open trades count as taken and as no P&L.
    """
    def fresh():
        return {"taken": []}

    def step(s, row):
        now = getattr(row, entry)
        closed = sum(points for end, points in s["taken"] if end <= now)
        ok = len(s["taken"]) < max_trades and not (stop_if_positive and closed > 0)
        if ok:
            s["taken"].append((getattr(row, exit), row.points))  # at most max_trades of them
        return (ok,)

    return ordered_walk(trades, sessions, [entry, ident], fresh, step, "allowed boolean")
