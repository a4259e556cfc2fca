"""Exact top-k search by inner product over M-trees.

Inner products become distances: with every vector x extended by sqrt(M^2 - |x|^2), M the largest norm of the table, and
every query q by zero, the squared distance is |q|^2 + M^2 - 2<q, x>. The nearest are the best, equal scores equal distances.

Vectors are dealt to the nearest of a bounded sample of pivots, and a crowded pivot's vectors by hash to several shards, so
that a shard has a bounded size whatever the table holds. A task bulk-loads each of its shards as an M-tree: pages of
entries, routing objects with covering radii, and of every entry the distance to its parent's routing object. Queries
stream past the tree in batches, which visit pages best-first by the least distance that is still possible; the stored
distances rule out entries and subtrees before theirs is computed.

Each query first searches the shard it lies in. What it finds there bounds the search: of all other shards it visits those
of which the pivot's covering radius leaves an equal or better vector possible. Scores are exact integers.
"""
from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import partitions, stored
from barloom.llm.vectors import integer_vectors, matrix

MOST_PIVOTS = 1024  # sampled vectors that tell shards apart
SHARD_ROWS = 1 << 16  # about as many rows a shard holds at most
PAGE, FANOUT = 256, 16  # entries of a leaf, and of an inner page
BATCH = 1024  # queries that walk a tree together
SLACK = 1e-6  # of the largest distance, for what doubles lose
NO_ID = np.iinfo(np.int64).max
NO_SCORE = -(1 << 62)


@dataclass
class Page:
    """A node: its routing object, covering radius and distance to the parent's object; children, or rows of the shard."""

    at: int
    radius: float
    to_parent: float
    children: list[Page] = field(default_factory=list)
    rows: np.ndarray | None = None
    to_object: np.ndarray | None = None  # of a leaf's rows the distance to its routing object


def reach_of(square: np.ndarray, score: np.ndarray) -> np.ndarray:
    """The distance at which a score is met; ``square``: |q|^2 + M^2."""
    return np.sqrt(np.maximum(square - 2.0 * score, 0.0))


class MTree:
    """An M-tree over rows of integers; ``top``: the largest squared norm there is. Rows are numbered by ascending id."""

    def __init__(self, v: np.ndarray, ids: np.ndarray, rows: np.ndarray, top: int, seed: int = 0):
        order = np.lexsort((rows, ids))
        self.ids, self.places, v = ids[order], rows[order], v[order]
        self.x = v.astype(np.float64)
        self.exact = self.x if top < 1 << 53 else v  # doubles hold every sum exactly as long as no product can exceed 2**53
        self.top, self.computed = float(top), 0
        self.lift = np.sqrt(np.maximum(top - (self.x * self.x).sum(axis=1), 0.0))
        self.root = self._load(np.arange(len(v)), 0, 0.0, np.random.default_rng(seed)) if len(v) else None

    def _apart(self, rows: np.ndarray, at: int) -> np.ndarray:
        gap, lift = self.x[rows] - self.x[at], self.lift[rows] - self.lift[at]
        return np.sqrt((gap * gap).sum(axis=1) + lift * lift)

    def _load(self, rows: np.ndarray, at: int, to_parent: float, rng: np.random.Generator) -> Page:
        to_object = self._apart(rows, at)
        radius = float(to_object.max())
        if len(rows) <= PAGE or radius == 0.0:
            return Page(at, radius, to_parent, rows=rows, to_object=to_object)
        objects = np.sort(rng.choice(rows, min(FANOUT, len(rows) // PAGE + 1), replace=False))
        home = np.stack([self._apart(rows, o) for o in objects]).argmin(axis=0)
        if (home == home[0]).all():  # the objects equal one another: what is far from the page's object goes apart
            home = (to_object > radius / 2).astype(np.int64)
        page = Page(at, radius, to_parent)
        for k in np.unique(home):
            own = rows[home == k]
            new = int(objects[k]) if objects[k] in own else int(own[0])
            page.children.append(self._load(own, new, float(self._apart(np.array([new]), at)[0]), rng))
        return page

    def search(self, q: np.ndarray, places: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each query the ``k`` best scores and the tree's rows that have them, -1 where there are fewer.

        ``places``: the queries' own rows of the table, which are no candidates. ``least``: a score that is met elsewhere; vectors
        below it may be left out.
        """
        x = q.astype(np.float64)
        exact = x if self.exact is self.x else q
        square = (x * x).sum(axis=1) + self.top
        slack = SLACK * np.sqrt(2.0 * self.top + 1.0)
        score, found = np.full((len(q), k), NO_SCORE), np.full((len(q), k), -1)
        reach = reach_of(square, least) + slack
        queue: list = []

        def away(at: int, open_: np.ndarray) -> np.ndarray:
            self.computed += len(open_)
            return np.sqrt(np.maximum(square[open_] - 2.0 * (x[open_] @ self.x[at]), 0.0))

        if self.root is not None and len(q):
            d = away(self.root.at, np.arange(len(q)))
            queue.append((0.0, 0, self.root, np.arange(len(q)), d, np.maximum(d - self.root.radius, 0.0)))
        pushed = 0
        while queue:
            _, _, page, open_, d, bound = heapq.heappop(queue)
            left = bound <= reach[open_]
            open_, d = open_[left], d[left]
            if not len(open_):
                continue
            for child in page.children:
                # |d(q, parent) - d(object, parent)| bounds d(q, object) without computing it.
                own = open_[np.abs(d - child.to_parent) - child.radius <= reach[open_]]
                if len(own):
                    own_d = away(child.at, own)
                    bound = np.maximum(own_d - child.radius, 0.0)
                    near = bound <= reach[own]
                    if near.any():
                        pushed += 1
                        heapq.heappush(queue, (float(bound[near].min()), pushed, child, own[near], own_d[near], bound[near]))
            for begin in range(0, len(page.rows) if page.rows is not None else 0, PAGE):
                rows, to_object = page.rows[begin:begin + PAGE], page.to_object[begin:begin + PAGE]
                near = np.abs(d[:, None] - to_object[None, :]) <= reach[open_][:, None]
                rows, own = rows[near.any(axis=0)], open_[near.any(axis=1)]
                if not len(rows):
                    continue
                self.computed += len(rows) * len(own)
                s = (exact[own] @ self.exact[rows].T).astype(np.int64)
                s[self.places[rows][None, :] == places[own][:, None]] = NO_SCORE
                worth = (s >= np.maximum(np.maximum(score[own, -1], least[own]), NO_SCORE + 1)[:, None]).any(axis=1)
                own, s = own[worth], s[worth]
                if not len(own):
                    continue
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                s = np.hstack([score[own], np.take_along_axis(s, best, axis=1)])
                r = np.hstack([found[own], rows[best]])
                by = np.lexsort((r, -s), axis=1)[:, :k]  # rows ascend by id
                score[own], found[own] = np.take_along_axis(s, by, axis=1), np.take_along_axis(r, by, axis=1)
                reach[own] = reach_of(square[own], np.maximum(score[own, -1], least[own])) + slack
        return score, np.where(score == NO_SCORE, -1, found)


@dataclass(frozen=True)
class Pivots:
    """The directory of shards: pivots, their covering radii, and how many shards each pivot's vectors fill."""

    v: np.ndarray
    lift: np.ndarray
    radius: np.ndarray | None = None
    first: np.ndarray | None = None
    shards: np.ndarray | None = None

    def apart(self, v: np.ndarray, lift: np.ndarray) -> np.ndarray:
        square = (v * v).sum(axis=1)[:, None] + (self.v * self.v).sum(axis=1)[None, :] - 2.0 * (v @ self.v.T) + (lift[:, None] - self.lift[None, :]) ** 2
        return np.sqrt(np.maximum(square, 0.0))


PIECE = 2048
PLACED = "row long, id long, v array<int>, pivot int, away double"
ASKED = "shard int, kind int, row long, id long, v array<int>, least long"
FOUND = "shard int, q_row long, q_id long, v array<int>, least long, ids array<long>, rows array<long>, scores array<long>"


def _placed(batches: Iterator[pa.RecordBatch], pivots: Pivots, dims: int, top: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(k, PIECE) for k in range(0, batch.num_rows, PIECE)):
            v = matrix(part.column("v"), dims).astype(np.float64)
            d = pivots.apart(v, np.sqrt(np.maximum(top - (v * v).sum(axis=1), 0.0)))
            home = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "id", "v")), pa.array(home.astype(np.int32)), pa.array(d[np.arange(len(d)), home])], names=["row", "id", "v", "pivot", "away"])


def _asked(batches: Iterator[pa.RecordBatch], pivots: Pivots, dims: int, top: int) -> Iterator[pa.RecordBatch]:
    """Queries under every shard, but their own, that may hold a vector as good as what they have found."""
    slack = SLACK * np.sqrt(2.0 * top + 1.0)
    for batch in batches:
        for part in (batch.slice(k, PIECE) for k in range(0, batch.num_rows, PIECE)):
            v = matrix(part.column("v"), dims).astype(np.float64)
            least, own = part.column("least").to_numpy(), part.column("shard").to_numpy()
            d = pivots.apart(v, np.zeros(len(v)))
            # A query ends in zero: what apart() adds for the pivots' last component is theirs.
            reach = reach_of((v * v).sum(axis=1) + top, least) + slack
            for p in range(len(pivots.v)):
                near = np.flatnonzero(d[:, p] - pivots.radius[p] <= reach)
                for shard in range(pivots.first[p], pivots.first[p] + pivots.shards[p]):
                    at = near[own[near] != shard]
                    if len(at):
                        rows = part.take(pa.array(at))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(at), shard, np.int32)), pa.array(np.ones(len(at), np.int32)), rows.column("q_row"), rows.column("q_id"), rows.column("v"), rows.column("least")],
                            names=["shard", "kind", "row", "id", "v", "least"])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(shard, kind, rows) for stretches of equal shard and kind, at most ``BATCH`` rows each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        shard, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
        starts = np.flatnonzero(np.append(True, (shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])))
        for begin, end in zip(starts, np.append(starts[1:], len(shard))):
            for at in range(begin, end, BATCH):
                yield int(shard[at]), int(kind[at]), batch.slice(at, min(BATCH, end - at))


def _searched(batches: Iterator[pa.RecordBatch], k: int, dims: int, top: int) -> Iterator[pa.RecordBatch]:
    """Rows come shard by shard, vectors (kind 0) before queries (kind 1)."""
    now, held, tree = None, [], None
    for shard, kind, part in _stretches(batches):
        if shard != now:
            now, held, tree = shard, [], None
        if kind == 0:
            held.append((matrix(part.column("v"), dims), part.column("id").fill_null(NO_ID).to_numpy(), part.column("row").to_numpy()))
            continue
        if tree is None:
            tree = MTree(*(np.concatenate(c) for c in zip(*held)), top, shard) if held else MTree(np.empty((0, dims), np.int64), np.empty(0, np.int64), np.empty(0, np.int64), top)
            held = []
        score, found = tree.search(matrix(part.column("v"), dims), part.column("row").to_numpy(), k, part.column("least").to_numpy())
        some = found >= 0
        longs = pa.list_(pa.int64())
        pick = lambda of: pa.array([of[f[s]].tolist() for f, s in zip(found, some)], longs)
        yield pa.RecordBatch.from_arrays(
            [part.column("shard"), part.column("row"), part.column("id"), part.column("v"), pa.array(np.maximum(score[:, -1], part.column("least").to_numpy())), pick(tree.ids), pick(tree.places),
             pa.array([x[s].tolist() for x, s in zip(score, some)], longs)],
            names=["shard", "q_row", "q_id", "v", "least", "ids", "rows", "scores"])


def top_vectors(df: DataFrame, every: int, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, scale: int = 256, shard_rows: int = SHARD_ROWS, pivots: int = MOST_PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: of every row whose id is divisible by ``every`` the ``k`` other rows of largest inner product.

    Components count as floor(scale * x). Equal scores go by id (null last), then by place in the table. A query's own row
    is no candidate, a repeated row with its id is; fewer rows than ``k`` give as many. Vectors that are null, or hold
    null or non-finite components or such that are 2**24 or more when scaled, take no part; a shorter vector counts as ending in zeros. An
    empty table gives no rows. Other columns are not looked at, whatever their names.
    """
    spark = df.sparkSession
    points = stored(integer_vectors(df, id_col, vec_col, scale))
    square = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x.cast("long"))
    n, dims, top = points.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(square), F.lit(0))).first()
    dims = max(dims, 1)
    size = min(shard_rows, max(PAGE, -(-n // (2 * partitions(spark)))))
    wanted = max(1, min(pivots, -(-n // size)))
    sample = points.select("v", F.xxhash64("row").alias("h")).orderBy("h").limit(wanted).collect()  # at most MOST_PIVOTS rows
    v = np.zeros((len(sample), dims))
    for at, r in enumerate(sample):
        v[at, :len(r["v"])] = r["v"]
    v = np.unique(v, axis=0) if len(v) else np.zeros((1, dims))
    near = Pivots(v, np.sqrt(np.maximum(top - (v * v).sum(axis=1), 0.0)))

    placed = stored(points.mapInArrow(lambda it: _placed(it, near, dims, top), PLACED))
    rows, radius = np.zeros(len(v), np.int64), np.zeros(len(v))
    for r in placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("away")).collect():  # a row a pivot
        rows[r["pivot"]], radius[r["pivot"]] = r["n"], r["away"]
    shards = np.maximum(-(-rows // size), 1)
    directory = Pivots(near.v, near.lift, radius, np.cumsum(shards) - shards, shards)

    of_pivot = F.array(*[F.struct(F.lit(int(a)).alias("first"), F.lit(int(b)).alias("shards")) for a, b in zip(directory.first, shards)])
    p = F.get(of_pivot, F.col("pivot"))
    shard = (p["first"] + F.pmod(F.xxhash64("row"), p["shards"])).cast("int").alias("shard")
    vectors = placed.select(shard, F.lit(0).alias("kind"), "row", "id", "v", F.lit(NO_SCORE).cast("long").alias("least"))
    queries = vectors.where(F.col("id") % every == 0).withColumn("kind", F.lit(1))

    def searched(asked: DataFrame) -> DataFrame:
        both = vectors.union(asked).repartition(partitions(spark), "shard").sortWithinPartitions("shard", "kind")
        return stored(both.mapInArrow(lambda it: _searched(it, k, dims, top), FOUND))

    at_home = searched(queries)
    elsewhere = searched(at_home.mapInArrow(lambda it: _asked(it, directory, dims, top), ASKED))
    hits = at_home.union(elsewhere).select("q_row", "q_id", F.explode(F.arrays_zip("ids", "rows", "scores")).alias("x"))
    w = Window.partitionBy("q_row").orderBy(F.col("x.scores").desc(), "x.ids", "x.rows")
    ranked = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    vec = F.when(F.col("x.ids") != NO_ID, F.col("x.ids"))
    return ranked.select(F.col("q_id").alias("query_id"), "rank", vec.alias("vec_id"), F.col("x.scores").alias("score"))
