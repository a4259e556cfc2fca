"""Exact dedup by sorting contents.

Rows are range-partitioned on the leading characters of the normalised text and a hash of all of it, by splitters
that Spark's range exchange samples; an external sort puts equal texts side by side and each row is compared with
its neighbour on the whole text. Contents so frequent that they would fill a partition are cut into salted runs
first; the few run heads of such contents are merged at the end. Each text is shuffled once.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import frequent, lower_ascii, partitions, stored, text_of

HEAD = 32


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Null text counts as empty; an empty text is a text like
    any other. ``keep`` says which id of a group stays; null ids lose against any other. Of repeated rows (same id,
    same text) one is kept and each counts. Other columns are ignored; an empty table gives no rows.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep: smallest or largest")
    n = partitions(docs.sparkSession)
    keyed = docs.select(F.col(id_col).alias("id"), lower_ascii(text_of(text_col)).alias("norm"))
    keyed = keyed.select("id", "norm", F.substring("norm", 1, HEAD).alias("head"), F.xxhash64("norm").alias("h"))
    hot = frequent(keyed.select("h"), docs.count())
    # At most about two rows a partition (see frequent), so this side stays small at any size.
    keyed = keyed.join(F.broadcast(hot), "h", "left")
    keyed = keyed.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id"), F.col("salts")), F.lit(0)).cast("int"))
    ranged = keyed.repartitionByRange(n, "head", "h", "salt")

    best, merge = (F.col("id").asc_nulls_last(), F.min) if keep == "smallest" else (F.col("id").desc_nulls_last(), F.max)
    run = Window.partitionBy("head", "h", "salt", "norm")
    order = run.orderBy(best)
    runs = stored(ranged.select(
        "id", F.sha2("norm", 256).alias("text_sha256"), F.col("salts").isNotNull().alias("hot"),
        F.row_number().over(order).alias("place"), F.first("id").over(order).alias("run_keep"), F.count(F.lit(1)).over(run).alias("run_size"),
    ))
    # One row per frequent content, as few as ``hot`` has.
    merged = (
        runs.where(F.col("hot") & (F.col("place") == 1))
        .groupBy("text_sha256").agg(merge("run_keep").alias("all_keep"), F.sum("run_size").alias("all_size"), F.min(F.lit(True)).alias("split"))
    )
    out = runs.join(F.broadcast(merged), "text_sha256", "left")
    out = out.withColumn("keep_id", F.when(F.col("split"), F.col("all_keep")).otherwise(F.col("run_keep")))
    out = out.withColumn("group_size", F.coalesce("all_size", "run_size"))
    # A salt is a function of the id, so rows of one id share a run. With null ids alone, the first salt's row stays.
    kept = (F.col("place") == 1) & F.col("id").eqNullSafe(F.col("keep_id"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"), "text_sha256")
