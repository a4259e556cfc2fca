"""Thresholds, votes, selections and models over scored trades."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.rmetrics import INF, VOTES, all_metrics
from barloom.functions.scalar import col, div, hash_long
from barloom.functions.trade import loss_penalty
from barloom.operators.boosting import BoostedTrees, fit_trees
from barloom.operators.scan import exact_quantiles
from barloom.session import cut


def evaluate_filter(df: DataFrame, by: Sequence[str], keep: Column, r: str = "r") -> DataFrame:
    """Metrics of the taken trades next to those of all trades, in one pass."""
    n, k = F.count(F.lit(1)), F.sum(F.when(keep, 1).otherwise(0))
    return df.groupBy(*by).agg(n.alias("n_all"), k.alias("n_taken"), (k / n).alias("take_rate"), *all_metrics(F.col(r), keep, "taken_"), *all_metrics(F.col(r), None, "all_"))


def per_config_metrics(df: DataFrame, threshold: float, config: str = "config_idx") -> DataFrame:
    keep = F.col("pred") >= threshold
    k = F.sum(F.when(keep, 1).otherwise(0))
    return df.groupBy(config).agg(F.count(F.lit(1)).alias("n_all"), k.alias("n_taken"), (k / F.count(F.lit(1))).alias("take_rate"), *all_metrics(F.col("r"), keep))


def threshold_table(df: DataFrame, by: Sequence[str], steps: int = 50, pred: str = "pred", r: str = "r") -> DataFrame:
    """R metrics of the trades at or above each of ``steps`` thresholds between the 5th and 95th percentile.

    Every trade is counted once, in the band between two thresholds; metrics of nested sets are suffix sums
    over the bands, so no trade is copied per threshold.
    """
    by = list(by)
    q = exact_quantiles(df, by, pred, [0.05, 0.95])
    ends = q.groupBy(*by).agg(F.max(F.when(F.col("p") < 0.5, F.col("q"))).alias("__lo"), F.max(F.when(F.col("p") > 0.5, F.col("q"))).alias("__hi"))
    cuts = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.when(i == steps - 1, F.col("__hi")).otherwise(F.col("__lo") + i * ((F.col("__hi") - F.col("__lo")) / (steps - 1))))
    ends = ends.withColumn("__cuts", cuts)
    d = df.join(ends, by) if by else df.withColumn("__cuts", ends.select("__cuts").scalar())
    x = F.col(r)
    band = F.size(F.filter("__cuts", lambda t: t <= F.col(pred))) - 1
    sums = d.groupBy(*by, band.alias("step")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("s"), F.sum((x > 0).cast("int")).alias("w"), F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0.0)).alias("up"),
        F.coalesce(F.sum(F.when(x < 0, -x)), F.lit(0.0)).alias("dn"), F.coalesce(F.sum(F.when(x < 0, x * x)), F.lit(0.0)).alias("sq"), F.sum((x < 0).cast("int")).alias("k"))
    frame = ends.select(*by, F.posexplode("__cuts").alias("step", "threshold"))
    frame = frame.join(sums, [*by, "step"], "left").fillna(0, subset=["n", "s", "w", "up", "dn", "sq", "k"])
    w = Window.partitionBy(*by).orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, 0)
    frame = frame.select(*by, "step", "threshold", *[F.sum(c).over(w).alias(c) for c in ("n", "s", "w", "up", "dn", "sq", "k")])
    whole = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_all")) if by else None
    frame = frame.join(whole, by) if by else frame.withColumn("n_all", df.agg(F.count(F.lit(1))).scalar())
    n, s = F.col("n"), F.col("s")
    mean = F.coalesce(div(s, n), F.lit(0.0))
    rms = F.sqrt(div(F.col("sq"), F.col("k")))
    return frame.select(
        *by, "step", "threshold", "n_all", F.col("n").alias("n_taken"), (n / F.col("n_all")).alias("take_rate"),
        F.coalesce(div(F.col("w"), n), F.lit(0.0)).alias("win_rate"), mean.alias("expectancy"),
        F.when(n == 0, 0.0).when(F.col("k") == 0, F.when(mean > 0, F.lit(INF)).otherwise(0.0)).otherwise(mean / F.nullif(rms, F.lit(0.0))).alias("sortino"),
        F.when(F.col("k") == 0, F.when(F.col("up") > 0, F.lit(INF)).otherwise(0.0)).otherwise(F.col("up") / F.nullif("dn", F.lit(0.0))).alias("profit_factor"))


def search_threshold(df: DataFrame, by: Sequence[str], metric: str = "sortino", steps: int = 50, min_take_rate: float = 0.15) -> DataFrame:
    """Threshold with the best metric among those that keep enough trades; the lowest wins ties."""
    t = threshold_table(df, by, steps)
    enough = F.col("n_taken") >= F.greatest(F.lit(1), F.floor(F.col("n_all") * min_take_rate))
    best = F.struct(metric, (-F.col("step")).alias("__o"))
    cols = [c for c in t.columns if c not in by]
    row = t.where(enough).groupBy(*by).agg(F.max_by(F.struct(*cols), best).alias("__r"))
    return row.select(*by, "__r.*")


def ensemble_vote(df: DataFrame, threshold: float, method: str, signal: Sequence[str], weights: DataFrame | None = None) -> DataFrame:
    """One row per signal the configurations agree to take, with the mean R of the yes votes."""
    vote = F.col("pred") >= threshold
    d = df if weights is None else df.join(weights, "config_idx", "left")
    weight = F.lit(1.0) if weights is None else F.coalesce(F.col("weight"), F.lit(0.0))
    g = d.groupBy(*signal).agg(VOTES[method](vote, weight).alias("__take"), F.avg(F.when(vote, F.col("r"))).alias("r"), F.count(F.lit(1)).alias("votes"))
    return g.where("__take").drop("__take")


def ensemble_summary(df: DataFrame, taken: DataFrame, signal: Sequence[str]) -> DataFrame:
    n = df.select(*signal).distinct().agg(F.count(F.lit(1))).scalar()
    return taken.agg(F.count(F.lit(1)).alias("n_taken"), *all_metrics(F.col("r"))).withColumn("n_signals", n).withColumn("take_rate", F.col("n_taken") / F.greatest(F.col("n_signals"), F.lit(1)))


def verdict(filtered: Column, baseline: Column, n: Column) -> Column:
    """PASS when the filtered Sortino is positive and beats all trades, MARGINAL when only positive."""
    return F.when((n == 0) | (filtered <= 0), "FAIL").when(filtered > baseline, "PASS").otherwise("MARGINAL")


def config_selection(val: DataFrame, test: DataFrame, threshold: float, top: int, metric: str = "sortino") -> DataFrame:
    """The best configurations on validation, judged on the test rows."""
    best = per_config_metrics(val, threshold).where("n_taken > 0").orderBy(F.desc(metric), "config_idx").limit(top)
    t = evaluate_filter(test, ["config_idx"], F.col("pred") >= threshold)
    d = best.select("config_idx", F.col(metric).alias("val_metric")).join(t, "config_idx", "left")
    return d.withColumn("verdict", verdict(F.coalesce("taken_sortino", F.lit(0.0)), F.coalesce("all_sortino", F.lit(0.0)), F.coalesce("n_taken", F.lit(0))))


# --- models ------------------------------------------------------------------------------------------

def fit_regressor(df: DataFrame, features: Sequence[str], label: str = "r", weight: str | None = None, trees: int = 300, depth: int = 4, rate: float = 0.05, subsample: float = 0.8, min_rows: int = 10, seed: int = 42) -> BoostedTrees:
    """Gradient-boosted trees on R; ``transform`` adds ``pred``."""
    return fit_regressors(df, None, features, label, weight, trees, depth, rate, subsample, min_rows, seed)[0]


def fit_regressors(df: DataFrame, models: Sequence[Column] | None, features: Sequence[str], label: str = "r", weight: str | None = None, trees: int = 300, depth: int = 4, rate: float = 0.05, subsample: float = 0.8, min_rows: int = 10, seed: int = 42) -> list[BoostedTrees]:
    """A regressor on the rows of each of ``models``, all fitted in the same jobs."""
    return fit_trees(df, features, label, weight, trees, depth, rate, subsample, min_rows, seed, models=models)


def fit_win_probability(df: DataFrame, features: Sequence[str], label: str, folds: int = 3, ident: str = "trade_id", trees: int = 300, depth: int = 4, rate: float = 0.05, seed: int = 42, weight: str | None = None):
    """Class-weighted boosted classifier and an isotonic map fitted on out-of-fold scores; ``weight``: a column of row weights."""
    from pyspark.ml.regression import IsotonicRegression

    share = df.agg(F.avg(F.col(label).cast("double"))).scalar()
    balance = F.when(F.col(label) == 1, 0.5 / F.nullif(share, F.lit(0.0))).otherwise(0.5 / F.nullif(1 - share, F.lit(0.0)))
    d = cut(df.withColumn("__w", balance * (F.lit(1.0) if weight is None else F.col(weight))).withColumn("__fold", hash_long(F.lit(seed), F.col(ident)) % folds))

    rows = [*[F.col("__fold") != k for k in range(folds)], F.lit(True)]
    *parts, whole = fit_trees(d, features, label, "__w", trees, depth, rate, 1.0, 1, seed, classify=True, models=rows)
    held_out = None
    for k, m in enumerate(parts):
        p = d.where(F.col("__fold") == k).select(m.probability().alias("score"), F.col(label).cast("double").alias("label"), F.col("__w").alias("w"))
        held_out = p if held_out is None else held_out.unionByName(p)
    return whole, IsotonicRegression(featuresCol="score", labelCol="label", predictionCol="p_win").fit(cut(held_out))


def win_probability(model: BoostedTrees, calibration, df: DataFrame) -> DataFrame:
    return calibration.transform(df.withColumn("score", model.probability()))


def save_model(model: BoostedTrees, path: str) -> None:
    model.save(SparkSession.active(), path)


def load_model(path: str) -> BoostedTrees:
    return BoostedTrees.load(SparkSession.active(), path)


def best_execution(df: DataFrame, model, candidates: Sequence[dict], ident: str) -> DataFrame:
    """Score every trade under each execution candidate and keep the best (first on ties)."""
    opts = F.array(*[F.struct(F.lit(i).alias("cand"), *[F.lit(float(v)).alias(k) for k, v in c.items()]) for i, c in enumerate(candidates)])
    names = list(candidates[0])
    wide = df.drop(*names).withColumn("__c", F.explode(opts)).select("*", "__c.*").drop("__c")
    scored = model.transform(wide)
    best = scored.groupBy(ident).agg(F.max_by(F.struct("cand", "pred", *names), F.struct("pred", (-F.col("cand")).alias("__o"))).alias("__b"))
    return best.select(ident, "__b.*")


def target_index(pred_r, tp_r, tp_next_r, n_candidates, risk=None) -> Column:
    """0 or 1: the second target when the predicted R reaches the midpoint between the first two.

    With ``risk`` the targets are distances in points: their midpoint is divided once, which rounds less than two quotients.
    """
    usable = (col(n_candidates) > 1) & (col(pred_r) > 0) & (col(tp_r) > 0) & (col(tp_next_r) > 0)
    midpoint = (col(tp_r) + col(tp_next_r)) / 2.0
    return F.when(usable & (col(pred_r) >= (midpoint if risk is None else div(midpoint, risk))), 1).otherwise(0)


def feature_importance(model, features: Sequence[str], spark) -> DataFrame:
    """Importances of a fitted model as rows (one per feature name)."""
    return spark.createDataFrame(pd.DataFrame({"feature": list(features), "importance": model.importances}))


def feature_share(importances: DataFrame) -> DataFrame:
    total = Window.partitionBy(F.lit(0))
    kind = F.when(F.col("feature").startswith("cfg_"), "config").otherwise("trade")
    return importances.groupBy(kind.alias("kind")).agg(F.sum("importance").alias("importance")).withColumn("share", F.coalesce(div(F.col("importance"), F.sum("importance").over(total)), F.lit(0.0)))


def top_features(importances: DataFrame, n: int = 10) -> DataFrame:
    return importances.orderBy(F.desc("importance"), "feature").limit(n)


@dataclass(frozen=True)
class WalkForward:
    """report: a row a fold, skipped ones included; pooled: the scored rows of all test windows; model and threshold of the last fit, None without a fold."""

    report: DataFrame
    pooled: DataFrame | None
    model: object | None
    threshold: float | None


def walk_forward_fit(df: DataFrame, folds: Sequence[dict], features: Sequence[str], date: str, metric: str = "sortino", min_train: int = 50, min_test: int = 10, weight: str | None = None, penalty: float | None = None, r: str = "r", **gbt) -> WalkForward:
    """Train per fold, search the threshold on the training rows, report the out-of-sample rows; fit once more on all rows.

    ``penalty`` weighs losses of the target so many times; thresholds and reports always take the real ``r``. A fold with
    fewer than ``min_train`` or ``min_test`` rows is reported as skipped. Folds are a handful; they are fitted in the same jobs.
    """
    label = "__target" if penalty is not None else r
    d = cut(df.withColumn("__target", loss_penalty(r, penalty)) if penalty is not None else df)
    inside = lambda f, w: F.col(date).between(F.lit(f[f"{w}_start"]), F.lit(f[f"{w}_end"]))
    sizes = d.agg(F.lit(0), *[F.count(F.when(inside(f, w), 1)) for f in folds for w in ("train", "test")]).first()[1:]
    sizes = list(zip(sizes[::2], sizes[1::2]))

    used = [f for f, (n, m) in zip(folds, sizes) if n >= min_train and m >= min_test]
    trained = [*[inside(f, "train") for f in used], F.lit(True)] if used else []

    def fitted(model: BoostedTrees, rows: Column) -> tuple[BoostedTrees, float]:
        best = search_threshold(model.transform(d.where(rows)), [], metric).first()
        return model, float(best["threshold"]) if best else 0.0

    *models, last = [fitted(m, rows) for m, rows in zip(fit_regressors(d, trained, features, label, weight, **gbt), trained)] if used else [None]
    keys = d.sparkSession.createDataFrame(
        [(int(f["fold"]), "fitted" if f in used else "skipped", int(n), int(m)) for f, (n, m) in zip(folds, sizes)], "fold int, status string, n_train long, n_test long")
    results = pooled = None
    for f, (model, threshold) in zip(used, models):
        mark = {"fold": F.lit(int(f["fold"])), "threshold": F.lit(threshold)}
        scored = model.transform(d.where(inside(f, "test"))).withColumns(mark)
        res = evaluate_filter(scored, [], F.col("pred") >= threshold, r).withColumns(mark)
        results = res if results is None else results.unionByName(res)
        pooled = scored if pooled is None else pooled.unionByName(scored)
    if results is None:
        results = evaluate_filter(d.limit(0), [], F.lit(True), r).withColumns({"fold": F.lit(None).cast("int"), "threshold": F.lit(None).cast("double")})
    return WalkForward(keys.join(results, "fold", "left"), pooled, *(last or (None, None)))
