"""Trade-log sink."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _fixed(c: str, places: int) -> Column:
    return F.coalesce(F.format_string(f"%.{places}f", F.bround(F.col(c).cast("double"), places)), F.lit(""))


def trade_log_rows(trades: DataFrame, strategy: str) -> DataFrame:
    """The 22 text columns of a trade log: prices with 2 decimals, R with 4, missing values empty."""
    two = lambda c, name=None: _fixed(c, 2).alias(name or c)
    four = lambda c: _fixed(c, 4).alias(c)
    return trades.select(
        F.lit(strategy).alias("strategy"), F.col("entry_ts").cast("string").alias("entry_time"), F.col("exit_ts").cast("string").alias("exit_time"),
        F.when(F.col("direction") == 1, "long").otherwise("short").alias("direction"), two("entry_price"), two("exit_price"), two("initial_sl_price", "initial_sl"), two("initial_tp_price", "initial_tp"),
        two("pnl_points"), two("pnl_dollars"), two("net_pnl_dollars"), four("r_multiple"), two("mae_points"), four("mae_r"), two("mfe_points"), four("mfe_r"),
        F.col("exit_reason"), F.coalesce(F.col("trade_reason"), F.lit("")).alias("trade_reason"), F.col("bars_held"), F.col("had_trailing"), two("slippage_paid"), two("commission_paid"))


def write_trade_log(trades: DataFrame, strategy: str, path: str, mode: str = "overwrite") -> None:
    trade_log_rows(trades, strategy).write.mode(mode).option("header", "true").option("emptyValue", "").csv(path)
