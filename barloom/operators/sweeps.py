"""Parameter sweeps and outcome grids."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.rmetrics import INF
from barloom.functions.scalar import div, hash_long, unit_hash
from barloom.operators.ledger import FEES
from barloom.operators.scan import exact_quantiles, medians, with_ordinal

SORTED_DAYS = 5


def daily_sortino(daily: DataFrame, by: Sequence[str], r: str = "day_r") -> list[Column]:
    """Aggregates of daily R sums: mean over deviation of the losing days; -inf under five days."""
    neg = F.when(F.col(r) < 0, F.col(r))
    sd = F.stddev_pop(neg)
    s = F.when(F.count(F.lit(1)) < SORTED_DAYS, F.lit(-INF)).when((F.count(neg) == 0) | (sd <= 0), F.lit(INF)).otherwise(F.avg(r) / F.nullif(sd, F.lit(0.0)))
    return [s.alias("sortino")]


def config_screen(trades: DataFrame, config: Sequence[str], n_days: int | Column, min_n: int = 0, min_tpd: float = 0.0, date: str = "date", r: str = "r") -> DataFrame:
    """Per configuration: count, trades a day, win rate, mean R, daily Sortino; small ones are dropped."""
    days = trades.groupBy(*config, date).agg(F.sum(r).alias("day_r"), F.count(F.lit(1)).alias("__n"), F.sum((F.col(r) > 0).cast("int")).alias("__w"))
    g = days.groupBy(*config).agg(F.sum("__n").alias("n"), F.sum("__w").alias("__w"), F.sum("day_r").alias("__s"), *daily_sortino(days, config))
    nd = n_days if isinstance(n_days, Column) else F.lit(n_days)
    g = g.withColumns({"tpd": F.col("n") / nd, "win_rate": F.col("__w") / F.col("n"), "avg_r": F.col("__s") / F.col("n")}).drop("__w", "__s")
    return g.where((F.col("n") >= min_n) & (F.col("tpd") >= min_tpd))


def filter_sweep(trades: DataFrame, config: Sequence[str], skips: Sequence[int], beyonds: Sequence[float], n_days: int | Column, min_n: int = 0, min_tpd: float = 0.0, date: str = "date", r: str = "r") -> DataFrame:
    """Score every (skip minutes, beyond ratio) filter of every configuration.

    The filters are nested, so trades are first summed into the cell of the strictest filters they pass;
    only cells, not trades, are spread over the filters. ``beyonds`` starts with -inf for "no filter".
    """
    rank = lambda c, xs: F.size(F.filter(F.array(*[F.lit(float(x)) for x in xs]), lambda t: t <= c)) - 1
    cells = trades.groupBy(*config, date, rank(F.col("elapsed").cast("double"), skips).alias("__i"), rank(F.col("beyond"), beyonds).alias("__j")).agg(
        F.sum(r).alias("__s"), F.count(F.lit(1)).alias("__n"), F.sum((F.col(r) > 0).cast("int")).alias("__w")).where("__i >= 0 and __j >= 0")
    d = cells.withColumn("__fi", F.explode(F.sequence(F.lit(0), F.col("__i")))).withColumn("__fj", F.explode(F.sequence(F.lit(0), F.col("__j"))))
    days = d.groupBy(*config, "__fi", "__fj", date).agg(F.sum("__s").alias("day_r"), F.sum("__n").alias("__n"), F.sum("__w").alias("__w"))
    by = [*config, "__fi", "__fj"]
    g = days.groupBy(*by).agg(F.sum("__n").alias("n"), F.sum("__w").alias("__w"), F.sum("day_r").alias("__s"), *daily_sortino(days, by))
    nd = n_days if isinstance(n_days, Column) else F.lit(n_days)
    at = lambda xs, c: F.element_at(F.array(*[F.lit(float(x)) for x in xs]), F.col(c) + 1)
    g = g.withColumns({"skip": at(skips, "__fi"), "beyond": at(beyonds, "__fj"), "tpd": F.col("n") / nd, "win_rate": F.col("__w") / F.col("n"), "avg_r": F.col("__s") / F.col("n")})
    return g.where((F.col("n") >= min_n) & (F.col("tpd") >= min_tpd)).drop("__fi", "__fj", "__w", "__s")


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def is_oos_compare(ins: DataFrame, oos: DataFrame, on: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """The same metrics in and out of sample side by side."""
    a = ins.select(*on, *[F.col(m).alias(f"is_{m}") for m in metrics])
    b = oos.select(*on, *[F.col(m).alias(f"oos_{m}") for m in metrics])
    return a.join(b, list(on), "left")


def perturb_params(configs: DataFrame, params: Sequence[str], pct: float, ident: str) -> DataFrame:
    """Each numeric parameter moved up and down by ``pct`` (missing and zero values are skipped)."""
    moves = F.explode(F.array(*[F.struct(F.lit(k + s).alias("key"), F.lit(k).alias("param"), (F.col(k).cast("double") * (1.0 + w * pct)).alias("value")) for k in params for s, w in (("+", 1), ("-", -1))]))
    return configs.select(ident, moves.alias("__m")).select(ident, "__m.*").where(F.col("value").isNotNull() & (F.col("value") != 0))


def aggregate_sensitivity(base: DataFrame, runs: DataFrame, ident: str, max_degradation: float, min_metric: float) -> DataFrame:
    """Worst perturbation of each configuration, its degradation, and the stable/valid flags."""
    worst = runs.groupBy(ident).agg(F.min("metric").alias("__m"), F.min_by("key", F.struct("metric", "key")).alias("__k"))
    d = base.join(worst, ident, "left")
    b = F.col("base_metric")
    hurt = F.coalesce(F.col("__m") < b, F.lit(False))
    d = d.withColumns({"worst_metric": F.when(hurt, F.col("__m")).otherwise(b), "worst_param": F.when(hurt, F.rtrim(F.col("__k"), F.lit("+-"))).otherwise("")})
    d = d.withColumn("degradation_pct", F.when(F.abs(b) < 1e-9, 0.0).otherwise((b - F.col("worst_metric")) / F.nullif(F.abs(b), F.lit(0.0)) * 100.0))
    d = d.withColumn("is_stable", F.col("degradation_pct") <= max_degradation)
    return d.withColumn("is_valid", F.col("is_stable") & (b >= min_metric)).drop("__m", "__k")


def sample_configs(slots: DataFrame, ident: str, ranges: dict[str, tuple[float, float]], integers: Sequence[str] = (), choices: dict[str, Sequence[str]] | None = None, seed: int = 42) -> DataFrame:
    """Latin hypercube: one configuration per input row, each parameter's strata used exactly once.

    The stratum of a row is its rank by a seeded hash, so the sample does not depend on partitioning.
    """
    d, n = slots.select(ident), slots.agg(F.count(F.lit(1))).scalar()
    for k, (lo, hi) in ranges.items():
        d = d.withColumn("__h", hash_long(F.lit(seed), F.lit(k), F.col(ident)))
        d = with_ordinal(d, [], ["__h", ident], F.shiftright("__h", 40), "__s")
        u = unit_hash(F.lit(seed), F.lit(k), F.lit("u"), F.col(ident))
        v = lo + (F.col("__s") - 1 + u) / n * (hi - lo)
        d = d.withColumn(k, F.greatest(F.lit(lo), F.least(F.lit(hi), F.bround(v))).cast("int") if k in integers else v).drop("__h", "__s")
    for k, xs in (choices or {}).items():
        d = d.withColumn(k, F.element_at(F.array(*[F.lit(x) for x in xs]), (hash_long(F.lit(seed), F.lit(k), F.col(ident)) % len(xs) + 1).cast("int")))
    return d


# --- outcome grids -----------------------------------------------------------------------------------

CELL = ["account", "scheme", "erp", "frp"]


def _fee(field: str) -> Column:
    lookup = F.create_map(*[F.lit(x) for a, fees in FEES.items() for x in (a, fees[("fee", "reset").index(field)])])
    return F.element_at(lookup, F.col("account"))


def eval_cost(pass_rate: Column) -> Column:
    """Expected evaluation fees until the first pass."""
    tries = F.greatest(F.lit(0.0), 1.0 / F.nullif(pass_rate, F.lit(0.0)) - 1.0)
    return _fee("fee") + F.when(pass_rate > 0, tries).otherwise(10.0) * _fee("reset")


def outcome_summary(paths: DataFrame, by: Sequence[str] = CELL, max_payouts: int = 5) -> DataFrame:
    """Pass rate, costs, survival, withdrawals, days and expected value per grid cell."""
    passed, w = F.col("passed"), F.col("withdrawn")
    g = paths.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_paths"), F.avg(passed.cast("double")).alias("pass_rate"), F.avg((w > 0).cast("double")).alias("survival"), F.avg(w).alias("mean_withdrawal"),
        F.avg((F.col("n_payouts") >= max_payouts).cast("double")).alias("full_payout"), F.avg("funded_days").alias("mean_funded_days"))
    m = medians(paths, by, {"days_pass": F.when(passed, F.col("eval_days")), "__df": F.when(~passed, F.col("eval_days")), "median_withdrawal": F.when(w > 0, w), "median_payouts": F.col("n_payouts")})
    g = g.join(m, list(by), "left").fillna(0.0, ["days_pass", "median_withdrawal"])
    g = g.withColumn("eval_cost", eval_cost(F.col("pass_rate")))
    tries = F.when(F.col("pass_rate") > 0, 1.0 / F.nullif("pass_rate", F.lit(0.0))).otherwise(10.0)
    g = g.withColumn("eval_total_days", F.greatest(F.lit(0.0), tries - 1) * F.coalesce("__df", "days_pass") + F.col("days_pass"))
    g = g.withColumn("net_ev", F.col("pass_rate") * F.col("mean_withdrawal") - F.col("eval_cost")).drop("__df")
    return g.withColumn("ev_per_day", F.col("net_ev") / F.greatest(F.lit(1.0), F.col("eval_total_days") + F.col("mean_funded_days")))


def per_k_payouts(paths: DataFrame, summary: DataFrame, max_k: int, by: Sequence[str] = CELL) -> DataFrame:
    """For K = 1..max: chance to reach K payouts, mean first-K sum, mean days, EV per day."""
    k = F.col("k")
    d = paths.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(max_k))))
    first = F.aggregate(F.slice("payout_amounts", F.lit(1), k), F.lit(0.0), lambda a, x: a + x)
    days = F.when(F.col("n_payouts") >= k, F.get("payout_days", k - 1)).otherwise(F.col("funded_days"))
    g = d.groupBy(*by, "k").agg(F.avg((F.col("n_payouts") >= k).cast("double")).alias("p_reach"), F.avg(first).alias("mean_first_k"), F.avg(days).alias("mean_days"))
    d = g.join(summary.select(*by, "pass_rate", "eval_cost", "eval_total_days"), list(by))
    d = d.withColumn("ev", F.col("pass_rate") * F.col("mean_first_k") - F.col("eval_cost"))
    return d.withColumn("ev_per_day", F.when(F.col("mean_days") > 0, div(F.col("ev"), F.col("eval_total_days") + F.col("mean_days")))).drop("pass_rate", "eval_cost", "eval_total_days")


def best_k(per_k: DataFrame, by: Sequence[str] = CELL) -> DataFrame:
    return per_k.groupBy(*by).agg(F.max_by(F.struct("k", "ev", "ev_per_day"), F.when(F.col("ev_per_day").isNotNull(), F.struct("ev_per_day", -F.col("k")))).alias("__b")).select(*by, "__b.*")


def payout_gaps(paths: DataFrame, by: Sequence[str] = CELL) -> DataFrame:
    """Median day of each payout and median wait since the one before."""
    d = paths.select(*by, "payout_days", F.posexplode("payout_days").alias("pos", "day"))
    gap = F.when(F.col("pos") == 0, F.col("day")).otherwise(F.col("day") - F.try_element_at("payout_days", F.col("pos")))
    d = d.select(*by, (F.col("pos") + 1).alias("payout"), "day", gap.alias("gap"))
    keys = [*by, "payout"]
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(medians(d, keys, {"median_day": F.col("day"), "median_gap": F.col("gap")}), keys, "left")


def best_cell(summary: DataFrame, by: Sequence[str] = ("account",)) -> DataFrame:
    """Grid cell with the highest EV per day."""
    cell = F.struct(*[c for c in (*CELL, "pass_rate", "net_ev", "ev_per_day") if c not in by])
    tie = F.struct("ev_per_day", "scheme", "erp", "frp")
    return summary.groupBy(*by).agg(F.max_by(cell, tie).alias("__b")).select(*by, "__b.*")


def stability_score(summary: DataFrame) -> DataFrame:
    """1 - largest EV step to a neighbouring evaluation risk, as a share of 20% of the EV range."""
    part = Window.partitionBy("account", "scheme", "frp")
    w = part.orderBy("erp")
    ev = F.col("net_ev")
    rng = F.greatest(F.max("net_ev").over(part) - F.min("net_ev").over(part), F.lit(1.0))
    drop = F.greatest(F.coalesce(F.abs(ev - F.lag("net_ev").over(w)), F.lit(0.0)), F.coalesce(F.abs(ev - F.lead("net_ev").over(w)), F.lit(0.0)))
    return summary.withColumn("stability", F.greatest(F.lit(0.0), 1.0 - drop / (rng * 0.20)))


def grid_pivot(summary: DataFrame, metric: str, frps: Sequence[float]) -> DataFrame:
    """erp rows x frp columns of one metric, with the best frp per erp."""
    by = ["account", "scheme", "erp"]
    wide = summary.groupBy(*by).pivot("frp", list(frps)).agg(F.first(metric))
    best = summary.groupBy(*by).agg(F.max_by("frp", F.struct(F.col(metric), F.col("frp"))).alias("best_frp"))
    named = wide.select(*by, *[F.col(f"`{f}`").alias("frp_" + str(f).replace(".", "_")) for f in frps])
    return named.join(best, by)


def grid_nest(summary: DataFrame, metric: str) -> DataFrame:
    """Cells as {scheme: {erp: {frp: value}}} per account (a bounded grid)."""
    pack = lambda k, v: F.map_from_entries(F.collect_list(F.struct(F.col(k).cast("string").alias("k"), F.col(v).alias("v"))))
    d = summary.groupBy("account", "scheme", "erp").agg(pack("frp", metric).alias("m"))
    d = d.groupBy("account", "scheme").agg(pack("erp", "m").alias("m"))
    return d.groupBy("account").agg(pack("scheme", "m").alias("grid"))


def grid_flatten(nested: DataFrame, value: str = "value") -> DataFrame:
    d = nested.select("account", F.explode("grid").alias("scheme", "m"))
    d = d.select("account", "scheme", F.explode("m").alias("erp", "m"))
    d = d.select("account", "scheme", "erp", F.explode("m").alias("frp", value))
    return d.withColumns({"erp": F.col("erp").cast("double"), "frp": F.col("frp").cast("double")})


def eval_funded_combine(paths: DataFrame) -> DataFrame:
    """Evaluation depends on erp only and funding on frp only: summarise each, then combine the two."""
    ev = paths.groupBy("account", "scheme", "erp").agg(F.avg(F.col("passed").cast("double")).alias("pass_rate"), F.avg("eval_days").alias("eval_days"))
    fu = paths.groupBy("account", "scheme", "frp").agg(F.avg("withdrawn").alias("mean_withdrawal"), F.avg("funded_days").alias("funded_days"))
    d = ev.join(fu, ["account", "scheme"]).withColumn("eval_cost", eval_cost(F.col("pass_rate")))
    d = d.withColumn("net_ev", F.col("pass_rate") * F.col("mean_withdrawal") - F.col("eval_cost"))
    return d.withColumn("ev_per_day", F.col("net_ev") / F.greatest(F.lit(1.0), F.col("eval_days") + F.col("funded_days")))


def final_cash_stats(paths: DataFrame, by: Sequence[str], cash: str, budget: float, goal: float, probs: Sequence[float] = (0.10, 0.25, 0.5, 0.75, 0.90)) -> DataFrame:
    """Chances of ending at nothing, ahead, or at the goal, with mean and exact percentiles."""
    c = F.col(cash)
    share = lambda x: F.avg(x.cast("double"))
    g = paths.groupBy(*by).agg(share(c <= 0).alias("p_zero"), share(c > budget).alias("p_profit"), share(c >= goal).alias("p_goal"), F.avg(c).alias("mean"))
    q = exact_quantiles(paths, by, cash, probs)
    wide = q.groupBy(*by).agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(f"p{round(p * 100)}") for p in probs])
    return g.join(wide, list(by))


def sweep_report(results: DataFrame, by: str) -> DataFrame:
    """Totals per strategy with its best row."""
    return results.groupBy(by).agg(
        F.count(F.lit(1)).alias("total"), F.sum(F.col("ev").isNotNull().cast("int")).alias("valid"), F.sum(F.when(F.col("ev") > 0, 1).otherwise(0)).alias("positive_ev"),
        F.max("ev").alias("best_ev"), F.max_by("combo_id", F.struct("ev", "combo_id")).alias("best_combo"))


def trade_pools(trades: DataFrame, labels: DataFrame, config: str, label_set: Sequence[int]) -> DataFrame:
    """Trades of each (configuration, regime) pool as rows; a regime without trades uses the whole pool."""
    d = trades.join(labels.select("date", "label"), "date", "left").withColumn("label", F.coalesce("label", F.lit(1)))
    have = d.groupBy(config).agg(F.array_sort(F.collect_set("label")).alias("__have"))
    d = d.join(have, config)
    empty = F.filter(F.array(*[F.lit(x) for x in label_set]), lambda x: ~F.array_contains("__have", x))
    return d.withColumn("pool", F.explode(F.concat(F.array("label"), empty))).drop("__have")
