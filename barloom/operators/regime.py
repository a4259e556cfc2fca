"""Market regimes: labels, transitions, conditional statistics."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalar import div
from barloom.operators.joins import default_lookup

NEUTRAL = 1


def label_trades(trades: DataFrame, labels: DataFrame) -> DataFrame:
    return default_lookup(trades, labels, ["date"], {"label": NEUTRAL})


def _trade_sharpe(x: Column) -> Column:
    sd = F.stddev_pop(x)
    return F.coalesce(F.when((F.count(x) >= 2) & (sd > 0), F.avg(x) / F.nullif(sd, F.lit(0.0)) * F.sqrt(F.lit(252.0))), F.lit(0.0))


def regime_breakdown(trades: DataFrame, label_set: Sequence[int], value: str) -> DataFrame:
    """Statistics per regime, regimes without trades included."""
    x = F.col(value)
    loss = F.coalesce(F.avg(F.when(x < 0, -x)), F.lit(1.0))
    g = trades.groupBy("label").agg(F.count(x).alias("n"), F.avg((x > 0).cast("double")).alias("win_rate"), F.avg(x).alias("avg_pnl"), F.sum(x).alias("total_pnl"), _trade_sharpe(x).alias("sharpe"), (F.avg(x) / loss).alias("expectancy_r"))
    dim = trades.sparkSession.createDataFrame([(int(v),) for v in label_set], "label int")
    return dim.join(g, "label", "left").fillna(0)


def is_oos_regime(trades: DataFrame, by: Sequence[str], oos_from: str, allowed: Sequence[int], value: str) -> DataFrame:
    """Sharpe in and out of sample, with and without the regime filter, in one pass."""
    x, oos, ok = F.col(value), F.col("date") >= F.lit(oos_from).cast("date"), F.col("label").isin(*allowed)
    s = lambda c: _trade_sharpe(F.when(c, x))
    return trades.groupBy(*by).agg(s(~oos).alias("is_all"), s(~oos & ok).alias("is_filtered"), s(oos).alias("oos_all"), s(oos & ok).alias("oos_filtered"))


def transition_matrix(labels: DataFrame, keys: Sequence[str], n_states: int, cap: float = 1e6) -> DataFrame:
    """Row-normalised counts of consecutive labels (dense) and expected stay 1/(1-p)."""
    keys = list(keys)
    nxt = F.lead("label").over(Window.partitionBy(*keys).orderBy("date"))
    counts = labels.withColumn("to", nxt).where("to is not null").groupBy(*keys, F.col("label").alias("from"), "to").agg(F.count(F.lit(1)).alias("n"))
    states = F.sequence(F.lit(0), F.lit(n_states - 1))
    dense = labels.select(*keys).distinct().withColumn("from", F.explode(states)).withColumn("to", F.explode(states))
    d = dense.join(counts, [*keys, "from", "to"], "left").fillna(0, subset=["n"])
    total = F.sum("n").over(Window.partitionBy(*keys, "from"))
    d = d.withColumn("p", F.coalesce(div(F.col("n"), total), F.lit(0.0)))
    return d.withColumn("stay_days", F.when(F.col("from") == F.col("to"), F.least(F.lit(cap), F.coalesce(div(F.lit(1.0), 1.0 - F.col("p")), F.lit(cap)))))


def initial_distribution(labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    g = labels.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def vol_regime_probability(labels: DataFrame, keys: Sequence[str], n_states: int = 3, high: int = 2) -> DataFrame:
    """P(today is the high state) from yesterday's label and the transitions seen before (one row a day)."""
    w = Window.partitionBy(*keys).orderBy("date")
    d = labels.withColumns({"__p": F.lag("label").over(w), "__rn": F.row_number().over(w)})
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    p = F.lit(1.0 / n_states)
    for s in range(n_states):
        seen = F.coalesce(F.sum((F.col("__p") == s).cast("int")).over(before), F.lit(0))
        hits = F.coalesce(F.sum(((F.col("__p") == s) & (F.col("label") == high)).cast("int")).over(before), F.lit(0))
        p = F.when(F.col("__p") == s, (hits + 1.0) / (seen + n_states)).otherwise(p)
    return d.withColumn("p_high", p).drop("__p", "__rn")


# --- Gaussian hidden Markov model --------------------------------------------------------------------

def _densities(x: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    """Of each day (first axis) under each refit and state."""
    return np.exp(-0.5 * (x[:, None, None] - mean) ** 2 / var) / np.sqrt(2 * np.pi * var) + 1e-300


@dataclass
class Models:
    """Gaussian hidden Markov models, one a refit: start (refits, states), trans (refits, from, to), mean and var (refits, states)."""

    start: np.ndarray
    trans: np.ndarray
    mean: np.ndarray
    var: np.ndarray

    def at(self, rows: np.ndarray) -> Models:
        return Models(self.start[rows], self.trans[rows], self.mean[rows], self.var[rows])

    def put(self, rows: np.ndarray, new: Models) -> None:
        for f in ("start", "trans", "mean", "var"):
            getattr(self, f)[rows] = getattr(new, f)


def _step(x: np.ndarray, ends: np.ndarray, m: Models) -> tuple[Models, np.ndarray]:
    """One Baum-Welch step of all refits; refit r holds the first ``ends[r]`` days, ends ascending. New models and log-likelihoods."""
    n, (refits, states) = int(ends[-1]), m.mean.shape
    x = x[:n]
    b = _densities(x, m.mean, m.var)
    alpha, beta, scale = np.zeros((n, refits, states)), np.ones((n, refits, states)), np.ones((n, refits))
    open_ = np.searchsorted(ends, np.arange(n), side="right")  # from which refit on a day is in the history
    a = m.start * b[0]
    for t in range(n):
        k = open_[t]
        if t:
            a = np.matmul(alpha[t - 1, k:, None, :], m.trans[k:])[:, 0] * b[t, k:]
        scale[t, k:] = a.sum(axis=1)
        alpha[t, k:] = a / scale[t, k:, None]
    for t in range(n - 2, -1, -1):
        k = open_[t + 1]
        beta[t, k:] = np.matmul(m.trans[k:], (b[t + 1, k:] * beta[t + 1, k:] / scale[t + 1, k:, None])[:, :, None])[:, :, 0]
    gamma = alpha * beta
    gamma /= np.maximum(gamma.sum(axis=2, keepdims=True), 1e-300)
    inside = np.arange(n)[:, None] < ends
    follow = np.where(inside[:, :, None], b * beta / scale[:, :, None], 0.0)
    pairs = m.trans * np.einsum("tri,trj->rij", alpha[:-1], follow[1:])
    trans = pairs / np.maximum(pairs.sum(axis=2, keepdims=True), 1e-300)
    weight = gamma.sum(axis=0)
    mean = np.einsum("trs,t->rs", gamma, x) / weight
    var = np.maximum((gamma * (x[:, None, None] - mean) ** 2).sum(axis=0) / weight, 1e-8)
    return Models(gamma[0], trans, mean, var), np.where(inside, np.log(scale), 0.0).sum(axis=0)


def fit_hmms(x: np.ndarray, ends: np.ndarray, n_states: int, iterations: int) -> Models:
    """Baum-Welch over all histories ``x[:end]`` at once (ends ascending), from quantile means (no random start); states ordered by mean.

    A refit that has converged leaves the arrays; the others go on, up to ``iterations`` steps.
    """
    ends = np.asarray(ends)
    mean, var = np.empty((len(ends), n_states)), np.empty((len(ends), n_states))
    for r, end in enumerate(ends):
        h = x[:end]
        edges = np.quantile(h, np.linspace(0, 1, n_states + 1))
        mean[r] = [h[(h >= lo) & (h <= hi)].mean() for lo, hi in zip(edges[:-1], edges[1:])]
        var[r] = max(h.var(), 1e-8)
    trans = np.full((len(ends), n_states, n_states), 0.1 / max(n_states - 1, 1))
    trans[:, np.arange(n_states), np.arange(n_states)] = 0.9
    models = Models(np.full((len(ends), n_states), 1.0 / n_states), trans, mean, var)
    going, last = np.arange(len(ends)), np.full(len(ends), -np.inf)
    for _ in range(iterations):
        new, ll = _step(x, ends[going], models.at(going))
        models.put(going, new)
        better = ll - last[going] >= 1e-4
        last[going] = ll
        going = going[better]
        if not len(going):
            break
    order = np.argsort(models.mean, axis=1, kind="stable")
    pick = lambda v: np.take_along_axis(v, order, axis=1)
    trans = np.take_along_axis(np.take_along_axis(models.trans, order[:, :, None], axis=1), order[:, None, :], axis=2)
    return Models(pick(models.start), trans, pick(models.mean), pick(models.var))


def last_states(x: np.ndarray, models: Models, ends: np.ndarray) -> np.ndarray:
    """For each day and refit the last state of the best path up to the day; refit r is asked up to day ``ends[r]``, ends ascending."""
    b, trans = np.log(_densities(x, models.mean, models.var)), np.log(models.trans + 1e-300)
    out = np.zeros(b.shape[:2], int)
    d = np.log(models.start + 1e-300) + b[0]
    out[0] = d.argmax(axis=1)
    for t in range(1, len(x)):
        k = int(np.searchsorted(ends, t, side="right"))
        d[k:] = (d[k:, :, None] + trans[k:]).max(axis=1) + b[t, k:]
        out[t, k:] = d[k:].argmax(axis=1)
    return out


def best_path(x: np.ndarray, model: Models) -> np.ndarray:
    """Viterbi path of all days under the first model."""
    b, trans = np.log(_densities(x, model.mean[:1], model.var[:1]))[:, 0], np.log(model.trans[0] + 1e-300)
    back, d = np.zeros(b.shape, int), np.log(model.start[0] + 1e-300) + b[0]
    for t in range(1, len(x)):
        m = d[:, None] + trans
        back[t], d = m.argmax(axis=0), m.max(axis=0) + b[t]
    path = np.zeros(len(x), int)
    path[-1] = d.argmax()
    for t in range(len(x) - 2, -1, -1):
        path[t] = back[t + 1][path[t + 1]]
    return path


def series_regimes(x: np.ndarray, n_states: int, train: int, refits: int, iterations: int) -> np.ndarray:
    """Labels of one series: its first ``train`` days by their own best path, each later day by the last refit before it."""
    n = len(x)
    every = max(1, (n - train) // refits)
    ends = np.arange(train, max(n, train + 1), every)
    models = fit_hmms(x, ends, n_states, iterations)
    tips = last_states(x, models, np.append(ends[1:], n))
    labels = np.empty(n, int)
    labels[:train] = best_path(x[:train], models)
    day = np.arange(train, n)
    labels[train:] = tips[day, (day - train) // every]
    return labels


def regime_labels(daily: DataFrame, keys: Sequence[str], value: str, n_states: int = 3, train_ratio: float = 0.5, refits: int = 50, iterations: int = 100, mode: str = "rolling") -> DataFrame:
    """(keys, date, label, in_sample): the regime of every day from refits on an expanding window.

    The first ``train_ratio`` of the days (all, but for ``mode="rolling"``) are labelled by a model fitted on all of them:
    ``in_sample``. A later day's label comes from a model of the days before its refit and from no later day.
    A series, at most one row a calendar day, is one group; its refits are fitted side by side as one axis of its arrays.
    """
    keys = list(keys)
    d = daily.select(*keys, "date", F.col(value).cast("double").alias("__x")).where(F.col("__x").isNotNull() & ~F.isnan("__x"))
    types = {f.name: f.dataType.simpleString() for f in daily.schema.fields}

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date").reset_index(drop=True)
        n = len(pdf)
        train = min(n, max(10, int(n * train_ratio))) if mode == "rolling" else n
        pdf["label"] = series_regimes(pdf["__x"].to_numpy(float), n_states, train, refits, iterations)
        pdf["in_sample"] = np.arange(n) < train
        return pdf[[*keys, "date", "label", "in_sample"]].astype({"label": "int32"})

    schema = ", ".join(f"`{c}` {types[c]}" for c in [*keys, "date"]) + ", label int, in_sample boolean"
    return d.groupBy(*keys).applyInPandas(label, schema)


def vol_regime(daily: DataFrame, keys: Sequence[str], **kw) -> DataFrame:
    """Regimes of the daily log range and the chance of the high one."""
    ranged = daily.withColumn("__lr", F.when((F.col("low") > 0) & (F.col("high") > 0), F.ln(F.col("high") / F.col("low"))))
    return vol_regime_probability(regime_labels(ranged, keys, "__lr", **kw), keys)
