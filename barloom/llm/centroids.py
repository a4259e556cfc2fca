"""Centroid clustering in exact integers, with centroids ruled out in rotated coordinates.

Vectors are rotated once onto the principal axes of the whole table. Of each, the leading coordinates and the norm of the
rest are stored. The squared distance of two vectors is at least that of their leading coordinates plus the squared
difference of their rests' norms; a centroid whose bound exceeds a distance already known cannot be the nearest. What the
bounds leave is measured in integers, so results depend neither on the rotation nor on rounding.

Rounds read the stored table, add up integers inside the tasks and bring one row a centroid and component to the driver.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import stored
from barloom.llm.vectors import integer_vectors, matrix

LEAD = 24  # leading coordinates that are stored
SLACK = 1e-9  # of a bound: far above what doubles lose
PIECE = 4096  # rows that are measured at a time


@dataclass(frozen=True)
class Rotation:
    """The leading principal axes (columns), and the point that is moved to zero."""

    axes: np.ndarray
    centre: np.ndarray

    def apply(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates and the norm of the rest."""
        x = v - self.centre
        lead = x @ self.axes
        return lead, np.linalg.norm(x - lead @ self.axes.T, axis=1)  # not by differences of squares, which cancel


def _moments(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    """Of a task: the sums of products of components i and j; one stands behind the last component."""
    total = np.zeros((dims + 1, dims + 1))
    for batch in batches:
        v = matrix(batch.column("v"), dims).astype(np.float64)
        v = np.hstack([v, np.ones((len(v), 1))])
        total += v.T @ v
    i, j = np.indices(total.shape, np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "total"])


def rotation(vectors: DataFrame, dims: int, lead: int = LEAD) -> Rotation:
    """Principal axes of all rows of ``vectors``; the driver gets (dims + 1) ** 2 sums."""
    parts = vectors.select("v").mapInArrow(lambda it: _moments(it, dims), "i int, j int, total double")
    m = np.zeros((dims + 1, dims + 1))
    for r in parts.groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
        m[r["i"], r["j"]] = r["total"]
    n = max(m[dims, dims], 1.0)
    centre = m[dims, :dims] / n
    _, axes = np.linalg.eigh(m[:dims, :dims] / n - np.outer(centre, centre))
    return Rotation(axes[:, ::-1][:, :lead].copy(), centre)


def _rotated(batches: Iterator[pa.RecordBatch], turn: Rotation) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lead, rest = turn.apply(matrix(batch.column("v"), len(turn.centre)).astype(np.float64))
        lists = pa.ListArray.from_arrays(np.arange(0, lead.size + 1, lead.shape[1], dtype=np.int32), pa.array(lead.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), lists, pa.array(rest)], names=["id", "v", "lead", "rest"])


def nearest(v: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, turn: Rotation) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row the nearest centroid (ties: the smaller number), the squared distance, and how many distances were measured in all."""
    c_lead, c_rest = turn.apply(centroids.astype(np.float64))
    bound = ((lead[:, None, :] - c_lead[None, :, :]) ** 2).sum(axis=2) + (rest[:, None] - c_rest[None, :]) ** 2
    # Rounding grows with the numbers that cancel, not with their difference.
    scale = (lead * lead).sum(axis=1) + rest * rest + (turn.centre * turn.centre).sum()
    bound -= SLACK * (scale[:, None] + ((c_lead * c_lead).sum(axis=1) + c_rest * c_rest)[None, :] + 1.0)
    order = np.argsort(bound, axis=1, kind="stable")
    best = np.full(len(v), np.iinfo(np.int64).max)
    number = np.full(len(v), len(centroids))
    open_, measured = np.arange(len(v)), 0
    for k in range(len(centroids)):
        c = order[open_, k]
        left = bound[open_, c] <= best[open_]  # bounds ascend: a row that closes stays closed
        open_, c = open_[left], c[left]
        if not len(open_):
            break
        gap = v[open_] - centroids[c]
        d = np.einsum("ij,ij->i", gap, gap)
        measured += len(d)
        better = (d < best[open_]) | ((d == best[open_]) & (c < number[open_]))
        best[open_[better]], number[open_[better]] = d[better], c[better]
    return number, best, measured


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, turn: Rotation) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, int]]:
    for batch in batches:
        for part in (batch.slice(k, PIECE) for k in range(0, batch.num_rows, PIECE)):
            v = matrix(part.column("v"), centroids.shape[1])
            lead = part.column("lead").flatten().to_numpy().reshape(len(v), -1)
            yield part, v, *nearest(v, lead, part.column("rest").to_numpy(), centroids, turn)


def _sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, turn: Rotation) -> Iterator[pa.RecordBatch]:
    """Of a task: for each centroid and component the number and the sum of its vectors, and (with the first) the distances measured."""
    k = len(centroids)
    total, count, tried = np.zeros(centroids.shape, object), np.zeros(k, np.int64), np.zeros(k, np.int64)
    for _, v, number, _, measured in _assigned(batches, centroids, turn):
        for c in np.unique(number):
            total[c] += v[number == c].sum(axis=0)
        count += np.bincount(number, minlength=k)
        tried[0] += measured
    # Sums leave as two longs: of 2**39 vectors or more, one would not do.
    c, j = np.indices(total.shape, np.int32)
    high, low = ([part(int(x)) for x in total.ravel()] for part in (lambda x: x >> 32, lambda x: x & 0xFFFFFFFF))
    per = lambda x: pa.array(np.repeat(x, total.shape[1]))
    yield pa.RecordBatch.from_arrays([pa.array(c.ravel()), pa.array(j.ravel()), per(count), pa.array(high, pa.int64()), pa.array(low, pa.int64()), per(tried)], names=["c", "j", "n", "high", "low", "tried"])


def _results(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, turn: Rotation) -> Iterator[pa.RecordBatch]:
    for part, _, number, best, _ in _assigned(batches, centroids, turn):
        yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(number.astype(np.int32)), pa.array(best)], names=["id", "cluster", "distance"])


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``<seed>:<id>``; null ids last, equal hashes by their vectors."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.select(h.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


@dataclass(frozen=True)
class Clustering:
    """Centroids in integers; assigned: id, cluster, distance; measured: distances that each round had to measure."""

    centroids: np.ndarray
    assigned: DataFrame | None
    measured: list[int]


def centroid_clusters(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 8, rounds: int = 10, scale: int = 1024, dims: int = 64, seed: str = "3", lead: int = LEAD) -> Clustering:
    """Lloyd's rounds over vectors of integers floor(scale * x), from ``k`` vectors chosen by hash.

    Kept are vectors of exactly ``dims`` components that are all finite and, scaled, below 2**24 in size (beyond, squared
    distances might not fit a long); others, null vectors among them, take no part. A round gives every vector to the
    nearest centroid (ties: the smaller number) and moves each centroid to the exact floor of its vectors' mean; one without
    vectors stays. Vectors are assigned once more at the end. Repeated rows count as often as they occur; fewer vectors than
    ``k`` give as many centroids; without any there is none, and ``assigned`` is empty. Null ids are kept. Other columns are not
    looked at, whatever their names.
    """
    spark = df.sparkSession
    vectors = stored(integer_vectors(df, id_col, vec_col, scale, dims).select("id", "v"))
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return Clustering(centroids.reshape(0, dims), spark.createDataFrame([], "id long, cluster int, distance long"), [])
    turn = rotation(vectors, dims, min(lead, dims))
    table = stored(vectors.mapInArrow(lambda it: _rotated(it, turn), "id long, v array<int>, lead array<double>, rest double"))
    measured = []
    for _ in range(rounds):
        now = centroids
        parts = table.mapInArrow(lambda it: _sums(it, now, turn), "c int, j int, n long, high long, low long, tried long")
        sums = [F.sum(c).alias(c) for c in ("n", "high", "low", "tried")]
        centroids, tried = now.copy(), 0
        for r in parts.groupBy("c", "j").agg(*sums).collect():  # centroids x components
            tried += r["tried"] if r["j"] == 0 else 0
            if r["n"]:
                centroids[r["c"], r["j"]] = ((r["high"] << 32) + r["low"]) // r["n"]
        measured.append(tried)
    last = centroids
    return Clustering(last, stored(table.mapInArrow(lambda it: _results(it, last, turn), "id long, cluster int, distance long")), measured)


def cluster_report(df: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector; see ``centroid_clusters``."""
    found = centroid_clusters(df, **options)
    own = {r["cluster"]: r["inertia"] for r in found.assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # a row a centroid
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()]
    per = F.array(*[F.struct(F.lit(own.get(c, 0)).cast("long").alias("inertia"), F.lit(m).alias("sha256")) for c, m in enumerate(marks)] or [F.struct(F.lit(0).cast("long").alias("inertia"), F.lit("").alias("sha256"))])
    mine = F.get(per, F.col("cluster"))
    return found.assigned.select(
        F.col("id").alias("vec_id"), "cluster", "distance", mine["inertia"].alias("cluster_inertia"), F.lit(sum(own.values())).cast("long").alias("inertia"), mine["sha256"].alias("centroid_sha256"))
