"""Ordered computations that survive a hot key.

A window partitioned by symbol alone puts a hot symbol in one task. The helpers here keep every task
small whatever the key distribution:

* ``with_ordinal`` / ``prefix`` work inside (key, block) and carry small per-block summaries forward;
* ``framed`` cuts a series into fixed-size ordinal chunks and copies the few neighbouring rows a frame
  can reach (the halo) into each chunk, so any bounded row frame is exact and partitions evenly.

``block`` must be monotone in the first ordering column (a day, an hour, an id range).
"""
from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from math import ceil, log
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.session import cut

ROWS_TO_HERE = (Window.unboundedPreceding, 0)
ROWS_BEFORE = (Window.unboundedPreceding, -1)


def day_of(ts: str) -> Column:
    return F.date_trunc("day", F.col(ts))


def hour_of(ts: str) -> Column:
    return F.date_trunc("hour", F.col(ts))


def with_ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, out: str = "ord") -> DataFrame:
    """1-based row position of every row within its key; a missing key is a key, missing values of ``order`` come last."""
    d = df.withColumn("__blk", block)
    part = [*keys, "__blk"]
    last = [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order]
    offsets = (
        d.groupBy(*part).agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__off", F.sum("__n").over(Window.partitionBy(*keys).orderBy(F.col("__blk").asc_nulls_last()).rowsBetween(*ROWS_BEFORE)))
        .select(*[F.col(c).alias(f"__p{k}") for k, c in enumerate(part)], "__off")
    )
    local = F.row_number().over(Window.partitionBy(*part).orderBy(*last))
    same = [F.col(c).eqNullSafe(F.col(f"__p{k}")) for k, c in enumerate(part)]
    return (
        d.withColumn("__rn", local)
        .join(offsets, reduce(and_, same), "left")
        .withColumn(out, F.coalesce(F.col("__off"), F.lit(0)) + F.col("__rn"))
        .drop("__blk", "__rn", "__off", *[f"__p{k}" for k in range(len(part))])
    )


def framed(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fn: Callable[[DataFrame, WindowSpec], DataFrame],
    before: int = 0,
    after: int = 0,
    block: Column | None = None,
    chunk: int = 4096,
) -> DataFrame:
    """Apply row-frame window logic reaching ``before``/``after`` rows, without one task per key.

    ``fn(d, w)`` may add columns over ``w`` in several steps as long as their total reach stays inside
    the halo. The global position is available as ``ord``.
    """
    size = max(chunk, before, after)
    d = with_ordinal(df, keys, order, day_of(order[0]) if block is None else block)
    at = F.col("ord") - 1
    home = F.floor(at / size)
    pos = at % size
    homes = F.array_compact(F.array(
        home,
        F.when(pos >= size - before, home + 1),
        F.when((pos < after) & (home > 0), home - 1),
    ))
    d = d.withColumn("__home", home).withColumn("__chunk", F.explode(homes))
    w = Window.partitionBy(*keys, "__chunk").orderBy("ord")
    return fn(d, w).where(F.col("__chunk") == F.col("__home")).drop("__chunk", "__home", "ord")


def prefix(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    aggs: dict[str, tuple[str, Column]],
    block: Column | None = None,
    exclusive: bool = False,
) -> DataFrame:
    """Running sum/count/max/min/last over all earlier rows of a key (blocked scan)."""
    d = df.withColumn("__blk", day_of(order[0]) if block is None else block)
    for name, (_, c) in aggs.items():
        d = d.withColumn(f"__in_{name}", c)
    part = [*keys, "__blk"]
    key_order = F.struct(*order) if len(order) > 1 else F.col(order[0])
    totals, carries, locals_ = [], {}, {}
    up_to = Window.partitionBy(*part).orderBy(*order).rowsBetween(*(ROWS_BEFORE if exclusive else ROWS_TO_HERE))
    over_blocks = Window.partitionBy(*keys).orderBy("__blk").rowsBetween(*ROWS_BEFORE)
    for name, (kind, _) in aggs.items():
        c, t = F.col(f"__in_{name}"), f"__t_{name}"
        if kind == "last":
            totals.append(F.max_by(c, F.when(c.isNotNull(), key_order)).alias(t))
            locals_[name] = F.last(c, ignorenulls=True).over(up_to)
            carries[name] = F.last(F.col(t), ignorenulls=True).over(over_blocks)
        else:
            agg = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[kind]
            totals.append(agg(c).alias(t))
            locals_[name] = agg(c).over(up_to)
            carries[name] = (F.sum if kind == "count" else agg)(F.col(t)).over(over_blocks)
    blocks = d.groupBy(*part).agg(*totals)
    blocks = blocks.select(*part, *[c.alias(f"__c_{n}") for n, c in carries.items()])
    d = d.withColumns({f"__l_{n}": c for n, c in locals_.items()}).join(blocks, part, "left")
    for name, (kind, _) in aggs.items():
        loc, car = F.col(f"__l_{name}"), F.col(f"__c_{name}")
        if kind in ("sum", "count"):
            d = d.withColumn(name, F.coalesce(loc, F.lit(0)) + F.coalesce(car, F.lit(0)))
        elif kind == "max":
            d = d.withColumn(name, F.greatest(loc, car))
        elif kind == "min":
            d = d.withColumn(name, F.least(loc, car))
        else:
            d = d.withColumn(name, F.coalesce(loc, car))
    return d.drop("__blk", *[f"__{p}_{n}" for n in aggs for p in ("in", "l", "c")])


def decay_halo(a: float) -> int:
    """Rows after which a state with decay ``a`` is below double precision (a**h < 1e-20)."""
    return ceil(46.0 / -log(a))


def decay_chunk(a: float) -> int:
    """Largest chunk for which a**-(chunk + halo) stays far inside the double range."""
    return max(64, int(580.0 / -log(a)) - decay_halo(a))


def affine(w: WindowSpec, a: float, b: Column) -> Column:
    """x_t = a*x_{t-1} + b_t inside a chunk, x before the chunk = 0 (exact behind a decay halo)."""
    i = F.row_number().over(w).cast("double")
    return F.pow(F.lit(a), i) * F.sum(b * F.pow(F.lit(a), -i)).over(w.rowsBetween(*ROWS_TO_HERE))


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], new_run: Column, block: Column | None = None, out: str = "run") -> DataFrame:
    """Number the runs of a series; ``new_run`` is true on the first row of each."""
    return prefix(df, keys, order, {out: ("sum", F.when(new_run, 1).otherwise(0))}, block)


def dealt_by_value(df: DataFrame, keys: Sequence[str], value: str, parts: int | None = None) -> DataFrame:
    """Distinct (keys, ``__v``) with their number ``__c``, sorted into ranges over all keys at once; ``__part``: the range.

    The splitters are sampled from the values themselves, so a range holds its share whatever the distribution, and a
    group as large as the table is spread over all ranges. Equal values are one row, so none is too frequent for a range.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.select(*keys, F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull())
    d = d.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c"))
    return cut(d.repartitionByRange(parts, *keys, "__v").withColumn("__part", F.spark_partition_id()))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], out: str = "q", parts: int | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles of groups of any size.

    Values are dealt to sampled ranges; the sums of the ranges say which of them hold a wanted rank, and only these are
    ordered, each on its own. Returns (keys, p, ``out``); a group without values gives no row.
    """
    keys = list(keys)
    if not keys:
        df, keys = df.select(F.lit(0).alias("__k"), value), ["__k"]
    dealt = dealt_by_value(df, keys, value, parts)
    sums = dealt.groupBy(*keys, "__part").agg(F.sum("__c").alias("__pc"))
    over = Window.partitionBy(*keys)
    sums = sums.withColumns({"__n": F.sum("__pc").over(over), "__before": F.sum("__pc").over(over.orderBy("__part").rowsBetween(*ROWS_TO_HERE)) - F.col("__pc")})
    place = lambda p: F.lit(float(p)) * (F.col("__n") - 1)
    ranks = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("p"), f(place(p)).cast("long").alias("rank")) for p in probs for f in (F.floor, F.ceil)]))
    wanted = sums.withColumn("__r", ranks).select(*keys, "__part", F.col("__r.p").alias("p"), F.col("__r.rank").alias("__rank"), "__n", "__before", "__pc")
    wanted = wanted.where((F.col("__rank") >= F.col("__before")) & (F.col("__rank") < F.col("__before") + F.col("__pc"))).distinct()
    inside = dealt.join(wanted.select(*keys, "__part").distinct(), [*keys, "__part"], "left_semi")
    inside = inside.withColumn("__cum", F.sum("__c").over(Window.partitionBy(*keys, "__part").orderBy("__v").rowsBetween(*ROWS_TO_HERE)))
    local = F.col("__rank") - F.col("__before")
    at = inside.join(wanted, [*keys, "__part"]).where((local >= F.col("__cum") - F.col("__c")) & (local < F.col("__cum")))
    pos = F.col("p") * (F.col("__n") - 1)
    res = at.groupBy(*keys, "p").agg(F.min_by("__v", "__rank").alias("__a"), F.max_by("__v", "__rank").alias("__z"), F.max("__n").alias("__n"))
    return res.select(*[k for k in keys if k != "__k"], "p", (F.col("__a") + (F.col("__z") - F.col("__a")) * (pos - F.floor(pos))).alias(out))


def medians(df: DataFrame, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """(keys, a column a name): exact medians of several expressions over groups of any size, NULL without values."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.cast("double").alias("value")) for n, c in values.items()])).alias("__m")
    q = exact_quantiles(df.select(*keys, each).select(*keys, F.col("__m.name").alias("__name"), F.col("__m.value").alias("__value")), [*keys, "__name"], "__value", [0.5])
    return q.groupBy(*keys).agg(*[F.max(F.when(F.col("__name") == n, F.col("q"))).alias(n) for n in values])


def ordered_walk(df: DataFrame, group: Sequence[str], order: Sequence[str], fresh: Callable[[], dict], step: Callable, out: str) -> DataFrame:
    """Sequential state machine per group over sorted partitions, in constant memory.

    ``step(state, row)`` returns the tuple of new columns declared in ``out``. Groups are hashed over tasks
    and streamed; no group is collected. Only for rules whose next state depends on the previous one.
    """
    columns, marks = list(df.columns), list(group)
    names = [c.strip().split()[0] for c in out.split(",")]

    def walk(batches):
        current, state = None, None
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                mark = tuple(getattr(row, g) for g in marks)
                if mark != current:
                    current, state = mark, fresh()
                rows.append(step(state, row))
            extra = list(zip(*rows)) if rows else [[] for _ in names]
            yield pdf[columns].assign(**{n: list(v) for n, v in zip(names, extra)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", " + out
    return df.repartition(*group).sortWithinPartitions(*group, *order).mapInPandas(walk, schema)
