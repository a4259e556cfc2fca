"""Look-ahead audit: a feature of a bar must not change when later bars are taken away."""
from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _comparable(df: DataFrame, until: datetime, digits: int) -> DataFrame:
    """Rows up to ``until``, fractions rounded: what two runs of one plan must agree on."""
    cols = [F.round(f"`{f.name}`", digits).alias(f.name) if f.dataType.simpleString() in ("double", "float") else F.col(f"`{f.name}`") for f in df.schema.fields]
    return df.where(F.col("ts") <= F.lit(until)).select(*cols)


def lookahead_audit(bars: DataFrame, features: dict[str, Callable[[DataFrame], DataFrame]], until: datetime, digits: int = 6) -> DataFrame:
    """(feature, n, changed): rows up to ``until``, and how many of them differ between all bars and the bars up to then.

    Each feature, a function of bars that keeps ``ts``, runs over both tables; rows only one of them gives count as changed.
    """
    short, parts = bars.where(F.col("ts") <= F.lit(until)), []
    for name, feature in features.items():
        whole, part = _comparable(feature(bars), until, digits), _comparable(feature(short), until, digits)
        marked = whole.withColumn("__a", F.lit(1)).unionByName(part.withColumn("__a", F.lit(-1)))
        rows = marked.groupBy(*whole.columns).agg(F.sum("__a").alias("__d"), F.count(F.when(F.col("__a") == 1, 1)).alias("__n"))
        parts.append(rows.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.abs("__d")), F.lit(0)).alias("changed")).select(F.lit(name).alias("feature"), "n", "changed"))
    return reduce(DataFrame.unionByName, parts)
