"""Feature and label tables for trade models."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.rmetrics import INF
from barloom.functions.scalar import col, div
from barloom.operators.clean import keep_last
from barloom.operators.scan import ROWS_BEFORE, framed, prefix

# Feature names and the labels they stand for.
CONFLUENCE_KINDS = {"OB": "conf_ob", "BB": "conf_bb", "FVG": "conf_fvg", "IFVG": "conf_ifvg", "RB": "conf_rb"}
CONFLUENCE_TIMEFRAMES = {"1m": "conf_tf_1m", "5m": "conf_tf_5m", "15m": "conf_tf_15m", "30m": "conf_tf_30m"}
SETUPS = {"OTE": "is_ote", "STDV": "is_stdv", "SESSION_OTE": "is_session_ote"}


def encode_signal_features() -> dict[str, Column]:
    """One-hot setup/zone/timeframe and ATR-scaled geometry of a signal row.

    Needs fib_type, direction, fib_value, conf_kind, conf_tf, leg_size_atr, zone_top, zone_bot, entry, sl,
    atr, tp_prices (array), chosen_tp, minutes_since_open, weekday, overnight_range_atr, n_levels, close.
    """
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    out = {name: flag(F.col("fib_type") == k) for k, name in SETUPS.items()}
    out.update({name: flag(F.col("conf_kind") == k) for k, name in CONFLUENCE_KINDS.items()})
    out["conf_session"] = flag((F.col("conf_kind") != "") & ~F.col("conf_kind").isin(*CONFLUENCE_KINDS))
    out.update({name: flag(F.col("conf_tf") == k) for k, name in CONFLUENCE_TIMEFRAMES.items()})
    atr, risk = F.greatest(F.col("atr"), F.lit(1e-9)), F.abs(F.col("entry") - F.col("sl"))
    usable = (risk > 1e-9) & (F.size("tp_prices") > 0)
    others = F.filter("tp_prices", lambda p: p != F.col("chosen_tp"))
    nearest = F.array_min(F.transform(others, lambda p: F.struct(F.abs(p - F.col("chosen_tp")).alias("d"), p.alias("p"))))["p"]
    out.update({
        "manip_leg_size_atr": F.col("leg_size_atr"),
        "zone_range_atr": (F.col("zone_top") - F.col("zone_bot")) / atr, "sl_risk_atr": risk / atr, "n_tp_candidates": F.size("tp_prices"),
        "tp_r": F.when(usable, F.abs(F.col("chosen_tp") - F.col("entry")) / F.nullif(risk, F.lit(0.0))).otherwise(-1.0),
        "tp_next_r": F.when(usable & (F.size(others) > 0), F.abs(nearest - F.col("entry")) / F.nullif(risk, F.lit(0.0))).otherwise(-1.0),
        "atr_pct": F.col("atr") / F.greatest(F.col("close"), F.lit(1e-9)) * 100.0,
        "time_since_open_min": F.col("minutes_since_open"), "day_of_week": F.col("weekday"),
        "n_validated_levels": F.col("n_levels"),
    })
    return out


def scale01(value, lo, hi) -> Column:
    """(v - lo) / (hi - lo) clipped to [0, 1]; 0 for a missing value or an empty range."""
    span = col(hi) - col(lo)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), div(col(value) - col(lo), span))), F.lit(0.0))


def normalize_config(configs: DataFrame, ranges: dict[str, tuple[float, float]], metric: str | None = None) -> DataFrame:
    """``cfg_<name>`` columns for a few literal parameter ranges, and the scaled quality metric."""
    d = configs.withColumns({f"cfg_{k}": scale01(F.col(k).cast("double"), F.lit(float(lo)), F.lit(float(hi))) for k, (lo, hi) in ranges.items()})
    return d if metric is None else d.withColumn("cfg_base_metric", metric01(F.col(metric)))


def metric01(m: Column) -> Column:
    """Metric clipped to [-2, 2] and mapped to [0, 1]."""
    return F.greatest(F.lit(-2.0), F.least(F.lit(2.0), m)) / 4.0 + 0.5


def trade_context(trades: DataFrame, config: Sequence[str], order: Sequence[str], date: str, r: str, block: Column | None = None) -> DataFrame:
    """Leak-free history of each trade: only strictly earlier trades of the same configuration count.

    Ten-trade statistics come from a haloed frame; everything older is carried as block totals, so a
    configuration with very many trades is spread over tasks.
    """
    rc, keys = F.col(r), list(config)

    def recent(d, w):
        f = w.rowsBetween(-10, -1)
        return d.withColumns({
            "recent_win_rate_10": F.coalesce(F.avg((rc > 0).cast("double")).over(f), F.lit(0.5)),
            "recent_expectancy_r_10": F.coalesce(F.avg(rc).over(f), F.lit(0.0)), "__o": F.col("ord")})

    d = framed(trades, keys, order, recent, before=10, block=block)
    loss = F.when(rc < 0, rc)
    d = prefix(d, keys, order, {
        "__n": ("count", F.lit(1)), "__s": ("sum", rc), "__k": ("count", loss), "__q": ("sum", loss * loss),
        "__lw": ("max", F.when(rc > 0, F.col("__o"))), "__ld": ("max", F.when(rc > 0, F.col(date))),
    }, block, exclusive=True)
    day = Window.partitionBy(*keys, date).orderBy(*order)
    mean = div(F.col("__s"), F.col("__n"))
    rms = F.sqrt(div(F.col("__q"), F.col("__k")))
    sortino = F.when(F.coalesce(rms, F.lit(0.0)) < 1e-9, F.when(mean > 0, F.lit(INF)).otherwise(0.0)).otherwise(mean / F.nullif(rms, F.lit(0.0)))
    return d.withColumns({
        "daily_trade_idx": F.row_number().over(day) - 1,
        "session_r_so_far": F.coalesce(F.sum(rc).over(day.rowsBetween(*ROWS_BEFORE)), F.lit(0.0)),
        "consecutive_losses": F.col("__o") - 1 - F.coalesce(F.col("__lw"), F.lit(0)),
        "days_since_last_win": F.coalesce(F.least(F.datediff(F.col(date), F.col("__ld")), F.lit(30)), F.lit(30)).cast("double"),
        "rolling_metric": F.when(F.col("__n") >= 5, metric01(sortino)).otherwise(0.5),
    }).drop("__o", "__n", "__s", "__k", "__q", "__lw", "__ld")


def reverse_ml_dataset(df: DataFrame) -> DataFrame:
    """The feature rows of the same trades taken the other way round."""
    tp = F.when(F.col("tp_r") == 0, 1e-6).otherwise(F.col("tp_r"))
    r = -F.col("r_multiple") / tp
    return df.withColumns({
        "direction": -F.col("direction"), "sl_risk_atr": F.col("sl_risk_atr") * tp, "tp_r": 1.0 / tp, "tp_next_r": F.lit(-1.0),
        "n_tp_candidates": F.lit(1), "r_multiple": r, "is_winner": (r > 0).cast("int"), "sl_pts": F.col("sl_pts") * tp,
        "net_pnl_dollars": -F.col("net_pnl_dollars")})


def union_keep_last(old: DataFrame, new: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Append a round; columns missing on one side become 0; the newest row per key stays."""
    both = old.unionByName(new, allowMissingColumns=True)
    added = [c for c in both.columns if c not in old.columns or c not in new.columns]
    return keep_last(both.fillna(0, subset=added), keys, [version])


def dataset_profile(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("r") > 0).cast("double")).alias("win_rate"), F.avg("r").alias("mean_r"), F.array_sort(F.collect_set("round")).alias("rounds"))


def split_label(date: Column, bounds: dict[str, tuple[str, str]]) -> Column:
    """Name of the date window a row falls in (inclusive bounds), NULL outside all."""
    out = F.lit(None).cast("string")
    for name, (lo, hi) in reversed(bounds.items()):
        out = F.when(date.between(F.lit(lo).cast("date"), F.lit(hi).cast("date")), name).otherwise(out)
    return out


def walk_forward_folds(df: DataFrame, date: str, train_months: int, test_months: int, embargo_months: int) -> DataFrame:
    """Fold bounds rolled over the data's own date range (one row per fold)."""
    span = df.agg(F.min(date).alias("s"), F.max(date).alias("e"))
    first = F.add_months("s", train_months + embargo_months)
    n = F.greatest(F.lit(0), F.floor(F.months_between("e", first) / test_months).cast("int") + 1)
    d = span.withColumn("fold", F.explode(F.sequence(F.lit(0), n))).withColumn("__d0", first)
    d = d.withColumn("test_start", F.add_months("__d0", F.col("fold") * test_months))
    d = d.withColumn("test_end", F.date_sub(F.add_months("test_start", test_months), 1)).where(F.col("test_end") <= F.col("e"))
    d = d.withColumn("train_end", F.date_sub(F.add_months("test_start", -embargo_months), 1))
    return d.withColumn("train_start", F.greatest("s", F.date_add(F.add_months("train_end", -train_months), 1))).select("fold", "train_start", "train_end", "test_start", "test_end")


def config_weights(df: DataFrame, config: str) -> DataFrame:
    """Weight 1/count of the row's configuration, scaled to mean 1 over all rows."""
    counts = df.groupBy(config).agg(F.count(F.lit(1)).alias("__c"))
    total = counts.agg(F.sum("__c") / F.count(F.lit(1))).scalar()
    return df.join(counts, config).withColumn("weight", total / F.col("__c")).drop("__c")
