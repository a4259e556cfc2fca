"""First bar beyond a level, through tiers of bar extremes with a fixed fan-out.

The bars of a series are cut into blocks of ``FAN_OUT``, these into blocks of as many blocks, and so on up to one. A block is
one row that holds its children's extremes as arrays. A level reads one row with the blocks it starts in, one of each
tier, and finds the lowest tier with a later child beyond the level; from there it reads one block a tier down to the bar. So a
level costs a row a tier, whatever the number of bars, or of bars a day, that lie between.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.bars import SYM
from barloom.operators.joins import asof_join, spread_join
from barloom.operators.scan import day_of, with_ordinal
from barloom.session import cut

FAN_OUT = 128


def _rank_in(values: Column, at: Column, inclusive: bool) -> Column:
    """How many of the ascending ``values`` lie before ``at`` (``inclusive``: or on it)."""
    return F.size(F.filter(values, (lambda t: t <= at) if inclusive else (lambda t: t < at)))


def _first_beyond(his: Column, los: Column, after: Column, strict: bool) -> Column:
    """Index of the first child behind index ``after`` whose extremes lie beyond the row's limits; NULL without one."""
    up, down = F.col("__upper"), F.col("__lower")
    hit = lambda h, l: F.coalesce(h > up if strict else h >= up, F.lit(False)) | F.coalesce(l < down if strict else l <= down, F.lit(False))
    marks = F.zip_with(his, los, hit)
    later = F.array_position(F.slice(marks, (after + 2).cast("int"), F.greatest(F.size(marks) - after - 1, F.lit(0)).cast("int")), F.lit(True))
    return F.when(later > 0, later + after)


@dataclass(frozen=True)
class Tiers:
    """An index over the bars of each key: leaf blocks (written once) and the number of tiers above single bars."""

    leaves: DataFrame
    keys: tuple[str, ...]
    payload: tuple[str, ...]
    depth: int
    fan_out: int

    def tier(self, t: int) -> DataFrame:
        """Blocks of tier ``t`` (1: of bars): keys, block, his, los."""
        d = self.leaves.select(*self.keys, "block", "his", "los")
        for _ in range(t - 1):
            child = F.struct((F.col("block") % self.fan_out).alias("k"), F.array_max("his").alias("hi"), F.array_min("los").alias("lo"))
            d = d.groupBy(*self.keys, F.floor(F.col("block") / self.fan_out).alias("block")).agg(F.array_sort(F.collect_list(child)).alias("c"))
            d = d.select(*self.keys, "block", F.col("c.hi").alias("his"), F.col("c.lo").alias("los"))
        return d

    def paths(self) -> DataFrame:
        """Leaf blocks with ``above``: of each higher tier the block they lie in."""
        d = self.leaves
        if self.depth == 1:
            return d.withColumn("above", F.array().cast("array<struct<t:int,his:array<double>,los:array<double>>>"))
        rows = None
        for t in range(2, self.depth + 1):
            size = self.fan_out ** (t - 1)
            below = F.explode(F.sequence(F.col("block") * size, F.col("block") * size + size - 1))
            # Only the blocks that exist below: a tier's last block may be cut short.
            own = self.tier(t).select(*self.keys, F.struct(F.lit(t).alias("t"), "his", "los").alias("up"), below.alias("block"))
            rows = own if rows is None else rows.unionByName(own)
        above = rows.groupBy(*self.keys, "block").agg(F.array_sort(F.collect_list("up")).alias("above"))
        return d.join(above, [*self.keys, "block"], "left")

    def start_of(self, levels: DataFrame, after: str, from_here: bool = False) -> DataFrame:
        """``levels``, a row each, with the leaf block of the last bar before they start."""
        first = self.leaves.select(*self.keys, F.col("ts")[0].alias("__first"), "block")
        d = asof_join(levels, first, list(self.keys), after, "__first", ["block"], strict=from_here)
        return d.withColumn("__blk", F.coalesce("block", F.lit(0))).drop("block")

    def first(self, levels: DataFrame, after: str, upper: Column | None = None, lower: Column | None = None, strict: bool = True, from_here: bool = False, out: str = "hit_ts") -> DataFrame:
        """``levels`` with the first bar behind ``after`` that lies above ``upper`` or below ``lower``: ``out``, its time, and ``hit``, its payload; NULL without one, or where ``after`` is NULL.

        ``from_here`` admits a bar at ``after``; without ``strict`` reaching a limit is enough. A NULL limit is never met.
        """
        none, keys = F.lit(None).cast("double"), list(self.keys)
        names = levels.columns
        d = self.start_of(levels.withColumns({"__upper": none if upper is None else upper.cast("double"), "__lower": none if lower is None else lower.cast("double")}), after, from_here)
        d = d.join(self.paths().withColumnRenamed("block", "__blk").withColumnRenamed("ts", "__ts").withColumnRenamed("bar", "__bar"), [*keys, "__blk"], "left")
        here = _first_beyond(F.col("his"), F.col("los"), _rank_in(F.col("__ts"), F.col(after), not from_here) - 1, strict)
        place = F.col("__blk")
        found = [F.when(here.isNotNull(), F.struct(F.lit(0).alias("t"), (place * self.fan_out + here).cast("long").alias("at"), F.element_at("__ts", (here + 1).cast("int")).alias("ts"), F.element_at("__bar", (here + 1).cast("int")).alias("bar")))]
        for t in range(2, self.depth + 1):
            block = F.get("above", F.lit(t - 2))
            child = _first_beyond(block["his"], block["los"], place % self.fan_out, strict)
            place = F.floor(place / self.fan_out)
            found.append(F.when(child.isNotNull(), F.struct(F.lit(t - 1).alias("t"), (place * self.fan_out + child).cast("long").alias("at"), F.lit(None).cast(self.leaves.schema["ts"].dataType.elementType).alias("ts"), F.lit(None).cast(self.leaves.schema["bar"].dataType.elementType).alias("bar"))))
        u = d.select(*names, "__upper", "__lower", F.when(F.col(after).isNotNull(), F.coalesce(*found)).alias("__x"))
        if self.depth == 1:
            return u.select(*names, F.col("__x.ts").alias(out), F.col("__x.bar").alias("hit"))
        u = cut(u)
        rows = u.count()
        done = u.where("__x IS NULL OR __x.t = 0").select(*names, F.col("__x.ts").alias(out), F.col("__x.bar").alias("hit"))
        going = None
        for t in range(self.depth - 1, 0, -1):
            new = u.where(F.col("__x.t") == t).select(*names, "__upper", "__lower", F.col("__x.at").alias("block"))
            going = new if going is None else going.unionByName(new)
            if t == 1:
                going = spread_join(going, self.leaves.withColumnRenamed("ts", "__ts").withColumnRenamed("bar", "__bar"), [*keys, "block"], rows)
                k = (_first_beyond(F.col("his"), F.col("los"), F.lit(-1), strict) + 1).cast("int")
                going = going.select(*names, F.element_at("__ts", k).alias(out), F.element_at("__bar", k).alias("hit"))
            else:
                going = spread_join(going, self.tier(t), [*keys, "block"], rows)
                k = _first_beyond(F.col("his"), F.col("los"), F.lit(-1), strict)
                going = going.select(*names, "__upper", "__lower", (F.col("block") * self.fan_out + k).cast("long").alias("block"))
        return done.unionByName(going)


def tiers(bars: DataFrame, keys: Sequence[str] = SYM, hi: str = "high", lo: str = "low", payload: Sequence[str] = (), fan_out: int = FAN_OUT) -> Tiers:
    """The index over columns ``hi`` and ``lo``; ``payload`` columns of the bar found come back with it."""
    keys = list(keys)
    bar = F.struct(F.col("ord").alias("o"), F.col("ts").alias("ts"), F.col(hi).cast("double").alias("hi"), F.col(lo).cast("double").alias("lo"), F.struct(*payload or [F.lit(True).alias("found")]).alias("bar"))
    d = with_ordinal(bars, keys, ["ts"], day_of("ts"))
    leaves = d.groupBy(*keys, F.floor((F.col("ord") - 1) / fan_out).alias("block")).agg(F.array_sort(F.collect_list(bar)).alias("b"))
    leaves = cut(leaves.select(*keys, "block", F.col("b.ts").alias("ts"), F.col("b.hi").alias("his"), F.col("b.lo").alias("los"), F.col("b.bar").alias("bar")))
    blocks, depth = (leaves.agg(F.max("block")).first()[0] or 0) + 1, 1
    while fan_out ** (depth - 1) < blocks:
        depth += 1
    return Tiers(leaves, tuple(keys), tuple(payload), depth, fan_out)
