"""Aggregate expressions over R multiples; register a name to use one as a metric or vote."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def _on(r: Column, keep: Column | None) -> Column:
    return r if keep is None else F.when(keep, r)


def win_rate_r(r: Column, keep: Column | None = None) -> Column:
    x = _on(r, keep)
    return F.coalesce(F.avg((x > 0).cast("double")), F.lit(0.0))


def expectancy_r(r: Column, keep: Column | None = None) -> Column:
    return F.coalesce(F.avg(_on(r, keep)), F.lit(0.0))


def sortino_r(r: Column, keep: Column | None = None, target: float = 0.0) -> Column:
    """(mean - t) / root mean square shortfall of the rows below t; +inf without shortfall, 0 if empty."""
    x = _on(r, keep)
    short = F.when(x < target, (x - target) * (x - target))
    mean = F.avg(x)
    return (
        F.when(F.count(x) == 0, F.lit(0.0))
        .when(F.count(short) == 0, F.when(mean > target, F.lit(INF)).otherwise(F.lit(0.0)))
        .otherwise((mean - target) / F.sqrt(F.nullif(F.avg(short), F.lit(0.0))))
    )


def profit_factor_r(r: Column, keep: Column | None = None) -> Column:
    x = _on(r, keep)
    up = F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0.0))
    down = F.coalesce(F.sum(F.when(x < 0, -x)), F.lit(0.0))
    return F.when(down == 0, F.when(up > 0, F.lit(INF)).otherwise(F.lit(0.0))).otherwise(up / F.nullif(down, F.lit(0.0)))


METRICS: dict[str, Callable[..., Column]] = {
    "win_rate": win_rate_r, "expectancy": expectancy_r, "sortino": sortino_r, "profit_factor": profit_factor_r,
}
VOTES: dict[str, Callable[[Column, Column | None], Column]] = {
    "majority": lambda vote, weight: F.avg(vote.cast("double")) > 0.5,
    "unanimous": lambda vote, weight: F.min(vote.cast("int")) == 1,
    "weighted": lambda vote, weight: F.sum(F.when(vote, weight).otherwise(0.0)) / F.nullif(F.sum(weight), F.lit(0.0)) > 0.5,
}


def register_metric(name: str, fn: Callable[..., Column]) -> None:
    METRICS[name] = fn


def register_vote(name: str, fn: Callable[[Column, Column | None], Column]) -> None:
    VOTES[name] = fn


def all_metrics(r: Column, keep: Column | None = None, tag: str = "") -> list[Column]:
    return [fn(r, keep).alias(f"{tag}{name}") for name, fn in METRICS.items()]
