"""Mixing sources to target weights by fitting each source's budget of words.

Documents are counted by source and exact length. A budget takes the same share of every length and leaves a small
rest, which a bounded knapsack over the lengths fills; each length's documents are then taken in a seeded order.
Lengths, not documents, reach the knapsack: a source with W words has at most sqrt(2 W) of them.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import frequent, partitions, stored, text_of, words_of

# Words of a budget that the knapsack decides; the longest-first fill before it stops this short of the budget.
REST = 65536


def knapsack(lengths: Sequence[int], free: Sequence[int], budget: int) -> np.ndarray:
    """How many items of each length make the sum nearest to ``budget`` (the smaller sum on a tie), within ``free``."""
    lengths, free = np.asarray(lengths, dtype=np.int64), np.asarray(free, dtype=np.int64)
    used = np.zeros(len(lengths), dtype=np.int64)
    usable = (lengths > 0) & (free > 0)
    if budget <= 0 or not usable.any():
        return used
    # A nearest sum is no farther from the budget than no item at all, and without one of its items no longer above it.
    top = budget + min(budget, int(lengths[usable].max()))
    via = np.full(top + 1, -1, dtype=np.int64)  # the bundle that first reached a sum
    reached = np.zeros(top + 1, dtype=bool)
    reached[0] = True
    bundles: list[tuple[int, int]] = []
    for k in np.flatnonzero(usable & (lengths <= top)):
        left, step = min(int(free[k]), top // int(lengths[k])), 1
        while left and not reached[budget]:
            step = min(step, left)
            w = step * int(lengths[k])
            new = np.zeros(top + 1, dtype=bool)
            new[w:] = reached[: top + 1 - w]
            new &= ~reached
            via[new] = len(bundles)
            reached |= new
            bundles.append((int(k), step))
            left, step = left - step, step * 2
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - budget))])
    while at:
        k, step = bundles[via[at]]
        used[k] += step
        at -= step * int(lengths[k])
    return used


def fit_budget(lengths: Sequence[int], counts: Sequence[int], budget: int, rest: int = REST) -> list[int]:
    """Documents to take of each length, so that their words come near to ``budget``.

    The same share of every length first; where few long documents leave that off the mark, without those shares.
    """
    lengths, counts = [int(x) for x in lengths], [int(x) for x in counts]
    total = sum(a * n for a, n in zip(lengths, counts))
    if budget <= 0 or not total:
        return [0] * len(lengths)
    if budget >= total:
        return counts

    def filled(taken: list[int]) -> list[int]:
        left = budget - sum(a * n for a, n in zip(lengths, taken))
        for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
            if lengths[k]:
                more = min(counts[k] - taken[k], max(left - rest, 0) // lengths[k])
                taken[k] += more
                left -= more * lengths[k]
        return [n + int(m) for n, m in zip(taken, knapsack(lengths, [n - t for n, t in zip(counts, taken)], left))]

    def off(taken: list[int]) -> int:
        return abs(sum(a * n for a, n in zip(lengths, taken)) - budget)

    even = filled([n * budget // total if a else 0 for a, n in zip(lengths, counts)])
    return even if not off(even) else min(even, filled([0] * len(lengths)), key=off)


def source_targets(sources: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """``sources`` (key, source, source_size) with the column target.

    Sources in order of code points, null last, weigh ``weights``, repeating. They share the words of all sources; none
    gets more than ``cap`` times its own, and what that frees is shared again. Only sums leave the executors.
    """
    n = partitions(sources.sparkSession)
    order = [F.col("source").isNull(), F.col("source")]
    placed = stored(sources.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    before = placed.groupBy("part").count().withColumn("before", F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1 + F.coalesce("before", F.lit(0))
    placed = placed.join(F.broadcast(before.drop("count")), "part")  # a row a partition
    placed = stored(
        placed.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights)).cast("int")))
        .withColumn("most", F.col("source_size") * float(cap)).drop("part", "before"))
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    full, level = -1, 0.0
    while True:
        above = F.col("most") < F.col("weight") * level
        n_full, held, weight = placed.agg(F.count(F.when(above, 1)), F.sum(F.when(above, F.col("most"))), F.sum(F.when(~above, F.col("weight")))).first()
        if n_full == full or not weight:
            break
        full, level = n_full, (total - (held or 0.0)) / weight
    return placed.withColumn("target", F.least(F.col("most"), F.col("weight") * level)).drop("most", "weight")


def _plan(group: pd.DataFrame) -> pd.DataFrame:
    """Of one source: whole repeats of every document, and how many documents of each length come once more."""
    group = group.sort_values("size")
    total, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
    repeats = int(target // total) if total else 0
    extra = fit_budget(group["size"], group["n"], int(round(target - repeats * total)))
    return pd.DataFrame({"key": group["key"], "size": group["size"], "repeats": repeats, "extra": extra, "source_size": total, "target": target})


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, seed: int = 42) -> DataFrame:
    """One row per document: row (its place in ``docs``), doc_id, size, source_size, target, copies.

    ``copies`` is how often the mix takes the document; the words of a source's copies come near its target, and no
    document is taken more than ``cap`` times. Null text has size 0 and is never taken; null sources are one source,
    last in order. Repeated rows are documents of their own. The choice depends on ids and ``seed`` alone. An empty
    table gives no rows.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    d = stored(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), key.alias("key"),
        F.size(words_of(text_of(text_col))).cast("long").alias("size"),
    ))
    lengths = stored(d.groupBy("key", "source", "size").agg(F.count(F.lit(1)).alias("n")))
    sources = lengths.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = source_targets(sources, weights, cap)
    plan = lengths.join(targets.drop("source"), "key").groupBy("key").applyInPandas(_plan, "key string, size long, repeats int, extra long, source_size long, target double")

    # Documents of one source and length, in parts where they are many (at most about two such pairs a partition).
    hot = frequent(d.select("key", "size"), d.count())
    dealt = d.join(F.broadcast(hot), ["key", "size"], "left")
    turn = F.xxhash64(F.lit(seed), F.col("doc_id"))
    dealt = dealt.withColumn("turn", turn).withColumn("part", F.coalesce(F.pmod("turn", F.col("salts")), F.lit(0)).cast("int"))
    parts = dealt.groupBy("key", "size", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("before", before).join(plan, ["key", "size"])
    parts = parts.withColumn("more", F.col("extra") - F.col("before")).drop("n", "before", "extra")
    place = F.row_number().over(Window.partitionBy("key", "size", "part").orderBy("turn", "doc_id"))
    out = dealt.drop("salts", "source").join(parts, ["key", "size", "part"]).withColumn("copies", F.col("repeats") + (place <= F.col("more")).cast("int"))
    return out.select("row", "doc_id", "size", "source_size", "target", F.when(F.col("size") > 0, F.col("copies")).otherwise(F.lit(0)).alias("copies"))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """``mix_plan`` in words: doc_id, size, source_size, target, taken (words of all copies)."""
    return mix_plan(docs, **options).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes them."""
    packed = docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc"))
    chosen = mix_plan(docs, **options).where(F.col("copies") > 0).select("row", "copies")
    return packed.join(chosen, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
