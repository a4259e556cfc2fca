"""Feature datasets, JSON caches, sweep results and manifests."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.scalar import params_hash

SWEEP_SCHEMA = (
    "combo_id string, params string, n_trades int, win_rate double, avg_r double, trades_per_day double, best_ev_per_day double, "
    "best_account string, best_scheme string, best_eval_risk double, best_funded_risk double, best_pass_rate double, screen_time_s double"
)


def read_ml_dataset(spark: SparkSession, path: str, columns: Sequence[str] | None = None, required: Sequence[str] = ()) -> DataFrame:
    """Feature rows with column pruning; ``required`` columns older files lack are added as 0."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    for c in required:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(0.0))
    return df if columns is None else df.select(*columns)


def stale_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """Required columns a stored dataset does not have yet."""
    return [c for c in required if c not in df.columns]


def write_ml_dataset(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy("split").parquet(path)


def read_json_map(spark: SparkSession, path: str, value_type: str) -> DataFrame:
    """A JSON object per file as (key, value) rows."""
    return explode_json_map(spark.read.text(path, wholetext=True), "value", value_type)


def explode_json_map(df: DataFrame, column: str, value_type: str) -> DataFrame:
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.explode(F.from_json(F.col(column), f"map<string,{value_type}>")).alias("key", "value"))


def split_key(df: DataFrame) -> DataFrame:
    """"hash:parameter" keys into two columns."""
    parts = F.split("key", ":", 2)
    return df.withColumns({"config_hash": parts[0], "param": F.get(parts, 1)})


def write_json_map(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.select(F.to_json(F.create_map(F.col("key"), F.col("value"))).alias("value")).write.mode(mode).text(path)


def read_sweep_results(spark: SparkSession, path: str, schema: str = SWEEP_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").csv(path)


def append_sweep_results(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", "true").csv(path)


def manifest_rows(configs: DataFrame, idx: str, params: str, algorithm: str = "sha256") -> DataFrame:
    body = F.map_from_entries(F.array_sort(F.map_entries(F.col(params))))
    return configs.withColumns({"line": F.to_json(F.struct(F.col(idx).alias("idx"), body.alias("params"))), "h": params_hash(F.col(params), algorithm)})


def write_manifest(configs: DataFrame, idx: str, params: str, path: str, mode: str = "overwrite") -> None:
    """Sampled configurations as JSON lines (idx, hash, params)."""
    manifest_rows(configs, idx, params).select(F.col(idx).alias("idx"), F.col("h").alias("hash"), F.col(params).alias("params")).write.mode(mode).json(path)
