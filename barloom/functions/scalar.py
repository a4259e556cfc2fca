"""Scalar column functions for prices, times, parameters and report text."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Retracement and extension ratios of a price leg, as ratios and multiples of its range.
OTE_RATIOS = (0.50, 0.618, 0.705, 0.79)
STDV_MULTIPLES = (2.0, 2.25, 2.5, 3.0, 3.25, 3.5, 4.0, 4.25, 4.5)
TICK = 0.25


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_to_tick(price, tick: float = TICK) -> Column:
    """Nearest tick, halves to the even tick."""
    return F.round(F.bround(col(price) / tick) * tick, 10)


def _whole(x: Column, way) -> Column:
    """``way`` (ceil or floor) of a double; beyond 2**53, of an infinity or NaN the number itself, which no long holds."""
    return F.when(F.abs(x) < 2.0**53, way(x)).otherwise(x)


def round_up(price, tick: float = TICK) -> Column:
    return _whole(col(price) / tick, F.ceil) * tick


def round_down(price, tick: float = TICK) -> Column:
    return _whole(col(price) / tick, F.floor) * tick


def minute_of_day(ts="ts") -> Column:
    return F.hour(col(ts)) * 60 + F.minute(col(ts))


def day_ordinal(ts="ts") -> Column:
    return F.datediff(F.to_date(col(ts)), F.lit("1970-01-01").cast("date"))


def weekday_mon0(ts="ts") -> Column:
    return F.weekday(col(ts))


def in_window(ts, start: int, end: int) -> Column:
    """Minute-of-day window, inclusive; wraps midnight when start > end."""
    m = minute_of_day(ts)
    return ((m >= start) & (m <= end)) if start <= end else ((m >= start) | (m <= end))


def params_hash(params: Column, algorithm: str = "sha256") -> Column:
    """Identity of a parameter map: digest of its key-sorted JSON (16 hex digits, or 12 for md5)."""
    text = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(params))))
    return F.substring(F.sha2(text, 256), 1, 16) if algorithm == "sha256" else F.substring(F.md5(text), 1, 12)


def ibs(high="high", low="low", close="close") -> Column:
    rng = col(high) - col(low)
    return F.when(rng > 0, (col(close) - col(low)) / rng).otherwise(0.5)


def log_return(now, before) -> Column:
    """Logarithm of now / before; from or to 0 infinite, between zeros NaN, NULL for a negative price."""
    n, b = col(now), col(before)
    flat = F.when((n == 0) & (b == 0), float("nan")).when((n == 0) & (b > 0), float("-inf")).when((n > 0) & (b == 0), float("inf"))
    return F.when((n > 0) & (b > 0), F.ln(n / F.nullif(b.cast("double"), F.lit(0.0)))).otherwise(flat)


def cagr(final, start, days) -> Column:
    years = F.greatest(col(days) / 252.0, F.lit(1e-9))
    return F.when(col(final) <= 0, F.lit(-1.0)).otherwise(F.pow(col(final) / col(start), 1.0 / years) - 1.0)


def fib_levels(low, high, direction, extension_reversed: bool = False) -> Column:
    """Candidate prices of a price leg as array<struct<price, direction, type, value>>.

    A bullish leg (1) gives shorts at its retracements and extensions below its low; a bearish leg (-1)
    gives longs and extensions above its high. ``extension_reversed`` flips the extension direction.
    """
    d, lo, hi = col(direction), col(low), col(high)
    rng = hi - lo
    ext = d if extension_reversed else -d

    def level(kind: str, v: float, way: Column, base: Column) -> Column:
        return F.struct((base - d * v * rng).alias("price"), way.cast("int").alias("direction"), F.lit(kind).alias("type"), F.lit(v).alias("value"))

    anchor, tail = F.when(d == 1, hi).otherwise(lo), F.when(d == 1, lo).otherwise(hi)
    levels = F.array(*[level("OTE", v, -d, anchor) for v in OTE_RATIOS], *[level("STDV", v, ext, tail) for v in STDV_MULTIPLES])
    return F.when(rng > 0, levels).otherwise(F.filter(levels, lambda _: F.lit(False)))


def zone_levels(kind, near, far, wick_tip=None, wick_base=None) -> Column:
    """Price levels of a zone: near, mid, far; a wick zone ("RB") adds fractions of its wick."""
    n, f = col(near), col(far)
    base = F.array(n, (n + f) / 2, f)
    if wick_tip is None:
        return base
    tip = col(wick_tip)
    wick = F.abs(col(wick_base) - tip)
    return F.when(col(kind) == "RB", F.concat(base, F.array(*[tip + r * wick for r in OTE_RATIOS]))).otherwise(base)


def config_label(pairs: Sequence[tuple[str, Column]]) -> Column:
    return F.concat_ws(" ", *[F.concat(F.lit(k + "="), v.cast("string")) for k, v in pairs])


def json_number(doc, key: str) -> Column:
    return F.expr(f"try_cast(get_json_object({doc}, '$.{key}') AS double)")


def fixed(x: Column, places: int) -> Column:
    """Text with so many decimals; what is below zero, a negative zero too, keeps its sign when it rounds to 0, as printf has it."""
    text = F.format_string(f"%.{places}f", F.bround(F.abs(x), places))
    return F.concat(F.when(x.cast("double").cast("string").startswith("-"), F.lit("-")).otherwise(F.lit("")), text)


def fmt_pct(x, places: int = 1) -> Column:
    return F.concat(fixed(col(x) * 100.0, places), F.lit("%"))


def fmt_dollar(x) -> Column:
    v = col(x)
    return F.concat(F.when(v < 0, F.lit("-")).otherwise(F.lit("")), F.lit("$"), F.format_number(F.abs(v), 0))


def fmt_number(x, places: int = 2) -> Column:
    return fixed(col(x), places)


def add_months_clamped(date, months) -> Column:
    return F.add_months(col(date), months)


def div(a, b) -> Column:
    """NULL instead of an error when the divisor is 0."""
    return col(a) / F.nullif(col(b).cast("double"), F.lit(0.0))


def ieee_div(a, b) -> Column:
    """Floating-point division as SQL engines and numpy have it: by 0 an infinity of the sign of both, of 0 or NaN by 0 NaN."""
    x, y = col(a).cast("double"), col(b).cast("double")
    below = y.cast("string") == "-0.0"
    by_zero = F.when(F.isnan(x) | (x == 0), float("nan")).when((x > 0) != below, float("inf")).otherwise(float("-inf"))
    return F.when(x.isNotNull() & (y == 0), by_zero).otherwise(x / F.nullif(y, F.lit(0.0)))


def ieee_ln(x) -> Column:
    """Logarithm as floating point has it: of 0 minus infinity, of a negative number NaN."""
    v = col(x)
    return F.when(v == 0, float("-inf")).when(v < 0, float("nan")).otherwise(F.ln(v))


def unit_hash(*parts) -> Column:
    """Uniform [0, 1) from an MD5 of the text parts: reproducible on any engine and any partitioning."""
    return hash_long(*parts) / F.lit(float(16 ** 12))


def hash_long(*parts) -> Column:
    text = F.concat_ws(":", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint")
