"""Bar sources and sinks: vendor text, Parquet, daily files."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Vendor column names and ours.
COLUMN_MAP = {
    "Date": "date_raw", "Time": "time_raw", "Open": "open", "High": "high", "Low": "low", "Last": "close", "Close": "close",
    "Volume": "volume", "NumberOfTrades": "num_trades", "BidVolume": "bid_volume", "AskVolume": "ask_volume",
}
REQUIRED = ("open", "high", "low", "close", "volume")
OPTIONAL = ("num_trades", "bid_volume", "ask_volume")
NEW_YORK = "America/New_York"


def read_bar_text(spark: SparkSession, path: str | Sequence[str], symbol: str | None = None) -> DataFrame:
    """Vendor CSV as bars with New York wall-clock times; unreadable numbers become NULL.

    ``path`` may name files, folders or many of them, which are read at once; without ``symbol`` the feeds are told apart by
    folders ``symbol=...``. ``ingest_id`` numbers the rows by file name and place in the file, whatever the order in which
    Spark reads them, for keep-first deduplication.
    """
    raw = spark.read.option("header", "true").option("ignoreLeadingWhiteSpace", "true").option("ignoreTrailingWhiteSpace", "true").csv(path)
    names = {c: COLUMN_MAP[c.strip()] for c in raw.columns if c.strip() in COLUMN_MAP}
    feed = F.lit(symbol) if symbol is not None else F.col("symbol") if "symbol" in raw.columns else None
    if feed is None:
        raise ValueError("name the symbol, or keep each feed in a folder symbol=...")
    place = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__row")]
    d = raw.select(feed.cast("string").alias("symbol"), *[F.col(f"`{c}`").alias(n) for c, n in names.items()], *place)
    missing = [c for c in ("date_raw", "time_raw", *REQUIRED) if c not in d.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; available {d.columns}")
    ts = F.to_timestamp_ntz(F.concat_ws(" ", F.trim("date_raw"), F.trim("time_raw")), F.lit("yyyy/MM/dd HH:mm:ss"))
    numbers = [F.expr(f"try_cast(trim({c}) AS double)").alias(c) for c in (*REQUIRED, *[o for o in OPTIONAL if o in d.columns])]
    split = ["__file", "__start"]
    # A row a split of a file: its rows begin behind those of all splits before it.
    sizes = d.groupBy(*split).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select(*split, (F.sum("__n").over(Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__before"))
    d = d.join(before, split).withColumn("ingest_id", F.col("__before") + F.row_number().over(Window.partitionBy(*split).orderBy("__row")) - 1)
    return d.select("symbol", ts.alias("ts"), *numbers, "ingest_id")


def localize(bars: DataFrame, zone: str = NEW_YORK, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """UTC instant of each wall-clock bar: gaps shift forward, a repeated hour is told apart by file order."""
    from barloom.operators.scan import framed

    def add(d, w):
        back = F.col("ts") < F.lag("ts").over(w)
        return d.withColumn("__back", F.coalesce(back, F.lit(False)))

    utc = F.to_utc_timestamp(F.col("ts").cast("timestamp"), zone)
    d = framed(bars, keys, ["ingest_id"], add, before=1, block=F.floor(F.col("ingest_id") / 1_000_000))
    falls = d.where("__back").select(*keys, F.to_date("ts").alias("__fd"), F.col("ingest_id").alias("__from")).groupBy(*keys, "__fd").agg(F.min("__from").alias("__from"))
    d = d.withColumn("__fd", F.to_date("ts")).join(falls, [*keys, "__fd"], "left")
    later = F.to_utc_timestamp((F.col("ts") + F.expr("INTERVAL 1 HOUR")).cast("timestamp"), zone)
    repeated = later - utc > F.expr("INTERVAL 1 HOUR")
    second = F.coalesce(F.col("ingest_id") >= F.col("__from"), F.lit(False))
    return d.withColumn("utc", F.when(repeated & second, utc + F.expr("INTERVAL 1 HOUR")).otherwise(utc)).drop("__back", "__fd", "__from")


def read_bars(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Parquet bars; date bounds prune ``bar_date`` partitions."""
    d = spark.read.parquet(path)
    if start:
        d = d.where(F.col("bar_date") >= F.lit(start).cast("date"))
    return d.where(F.col("bar_date") <= F.lit(end).cast("date")) if end else d


def write_bars(bars: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One directory per (symbol, bar_date); rows are sent to their directory's writer and sorted."""
    d = bars.withColumn("bar_date", F.to_date("ts"))
    d.repartition("symbol", "bar_date").sortWithinPartitions("symbol", "bar_date", "ts").write.mode(mode).partitionBy("symbol", "bar_date").parquet(path)


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.parquet(path)
    names = {"Date": "date", "Open": "open", "High": "high", "Low": "low", "Last": "close", "Close": "close", "Volume": "volume"}
    return d.select(*[F.col(c).alias(names.get(c, c)) for c in d.columns]).withColumn("date", F.to_date("date"))
