"""Shared pieces of the training-data operators."""
from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space of every operator here: space and the five ASCII controls from tab to carriage return.
SPACE = r"[ \x09-\x0D]"
SPACES = SPACE + "+"
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only a local session, whose executors are threads of the driver, may do without the setting.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = os.path.join(tempfile.gettempdir(), f"barloom-{sc.applicationId}")
    sc._conf.set("spark.checkpoint.dir", path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage for results that feed several branches; a lost executor costs a re-read. The shuffle files of the plan
    go once the table is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    was = spark.conf.get(FREED)
    spark.conf.set(FREED, "true")  # nothing reads the shuffles of this plan again
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREED, was)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def dropped(*tables: DataFrame | None) -> None:
    """Delete tables that ``stored`` has written and that nothing reads any more. None is passed over."""
    for table in tables:
        if table is not None:
            spark = table.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def beside(df: DataFrame, rows: int | None = None, most: int = 1 << 16) -> DataFrame:
    """``df`` as one side of a join: broadcast if it has at most ``most`` rows, else merged.

    Spark sizes a stored table by its compressed files, and what is exploded from it by the rows before, so it may send millions
    of rows through the driver. Here counted ``rows`` decide; without a count the sides are merged.
    """
    return F.broadcast(df) if rows is not None and rows <= most else df.hint("merge")


def bind(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is evaluated once, also where lambdas inside ``fn`` use it."""
    return F.transform(F.array(value), fn)[0]


def text_of(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def lower_ascii(c: Column) -> Column:
    """A-Z to lower case, other characters as they are."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def words_of(c: Column) -> Column:
    """The words of a text: maximal runs of characters that are not white space."""
    return F.array_remove(F.split(c, SPACES), "")


def frequent(keys: DataFrame, rows: int, per_partition: int = 50, seed: int = 42) -> DataFrame:
    """Keys that hold more than about half a partition's share of the rows, with the number of salts to split each into.

    Estimated on a sample of ``per_partition`` rows a partition, so there are at most about two such keys per
    partition: the result may be broadcast. It only steers how work is dealt out, never what is computed.
    """
    n = partitions(keys.sparkSession)
    share = min(1.0, per_partition * n / max(rows, 1))
    least = max(2, per_partition // 2)
    return (
        keys.sample(share, seed).groupBy(*keys.columns).count().where(F.col("count") >= least)
        .withColumn("salts", F.ceil(F.col("count") * 2 / least).cast("int")).drop("count")
    )
