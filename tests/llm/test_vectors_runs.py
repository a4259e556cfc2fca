"""Clusters, exact search and periodic runs against brute force."""
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from barloom.llm import centroids, runs, top_vectors
from barloom.llm.centroids import centroid_clusters, cluster_report
from barloom.llm.runs import Grammar, periodic_runs, run_report, word_runs
from tests.llm import data

VECTORS = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("row", T.StringType()),
    T.StructField("cluster", T.IntegerType()), T.StructField("score", T.StringType()),
])


def vectors(dims, n=160, seed=3):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dims))
    v[: n // 3] = v[0]  # one vector in a third of the rows
    v[n // 2: n // 2 + n // 8] = v[n // 2] + 0.01 * rng.normal(size=(n // 8, dims))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    rows = [(5 * k - 30, x.tolist(), "r", k, "s") for k, x in enumerate(v)]
    bad = [math.nan, math.inf, -math.inf, None, 3e38]
    rows += [(10_000 + 50 * k, [*rows[0][1][:-1], x], None, None, None) for k, x in enumerate(bad)]
    rows += [(20_000, None, None, None, None), (20_050, [], None, None, None), (20_100, [0.5] * (dims - 1), None, None, None), (20_150, [0.0] * dims, None, None, None)]
    rows += [(None, rows[7][1], None, None, None), rows[8], rows[8], rows[n // 2]]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, VECTORS).repartition(3)


def integers(x, scale):
    return None if x is None or any(c is None or not math.isfinite(c) or abs(c * scale) >= 2**24 for c in x) else [math.floor(scale * c) for c in x]


def lloyd(rows, k, rounds, scale, dims):
    kept = [(i, v) for i, x, *_ in rows if (v := integers(x, scale)) is not None and len(v) == dims]
    by_hash = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in by_hash[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((apart(v, x), n) for n, x in enumerate(c)) for _, v in kept]
    for _ in range(rounds):
        now = assign()
        for n in range(len(c)):
            own = [v for (_, v), (_, m) in zip(kept, now) if m == n]
            if own:
                c[n] = [sum(col) // len(own) for col in zip(*own)]
    now = assign()
    total = sum(d for d, _ in now)
    return sorted((str(i), n, d, sum(e for e, m in now if m == n), total, hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, now))


@pytest.mark.parametrize("dims,k,n", [(8, 8, 160), (64, 8, 90), (5, 3, 30)])
def test_clusters_against_lloyd(spark, dims, k, n):
    rows = vectors(dims, n)
    got = cluster_report(frame(spark, rows), k=k, dims=dims)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((str(r.vec_id), *r[1:]) for r in got.collect()) == lloyd(rows, k, 10, 1024, dims)


def test_few_and_no_vectors(spark):
    rows = vectors(4, 30)
    assert cluster_report(frame(spark, []), dims=4).collect() == []
    assert cluster_report(frame(spark, rows[30:39]), dims=7).collect() == []
    few = [rows[0], rows[1], rows[29]]
    assert sorted((str(r.vec_id), *r[1:]) for r in cluster_report(frame(spark, few), dims=4).collect()) == lloyd(few, 8, 10, 1024, 4)


def test_bounds_rule_centroids_out(spark):
    rng = np.random.default_rng(4)
    mids = rng.normal(size=(8, 16))
    rows = [(k, (mids[k % 8] + 0.05 * rng.normal(size=16)).tolist(), None, None, None) for k in range(400)]
    found = centroid_clusters(frame(spark, rows), k=8, dims=16, lead=4)
    assert len(found.measured) == 10 and max(found.measured) < 0.5 * 400 * 8
    v = np.array([integers(x, 1024) for _, x, *_ in rows])
    turn = centroids.Rotation(np.eye(16)[:, :4], v.mean(axis=0))
    lead, rest = turn.apply(v.astype(float))
    number, d, measured = centroids.nearest(v, lead, rest, found.centroids, turn)
    all_d = ((v[:, None] - found.centroids[None]) ** 2).sum(axis=2)
    assert (number == all_d.argmin(axis=1)).all() and (d == all_d.min(axis=1)).all() and measured < all_d.size


def best(rows, every, k, scale):
    kept = [(n, i, v) for n, (i, x, *_) in enumerate(rows) if (v := integers(x, scale)) is not None]
    out = []
    for n, i, q in kept:
        if i is not None and i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j is None, j or 0) for m, j, v in kept if m != n)[:k]
            out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(scores)]
    return sorted(out, key=str)


@pytest.mark.parametrize("dims,n,shard,pivots", [(8, 160, 1 << 16, 1024), (64, 90, 1 << 16, 1024), (6, 700, 64, 5)])
def test_top_vectors_against_all_pairs(spark, monkeypatch, dims, n, shard, pivots):
    monkeypatch.setattr(top_vectors, "PAGE", 16)
    rows = vectors(dims, n)
    got = top_vectors.top_vectors(frame(spark, rows), every=25, k=5, shard_rows=shard, pivots=pivots)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == best(rows, 25, 5, 256)


def test_top_vectors_of_few_rows_and_none(spark):
    rows = vectors(3, 9)[:3]
    assert sorted((tuple(r) for r in top_vectors.top_vectors(frame(spark, rows), every=5).collect()), key=str) == best(rows, 5, 5, 256)
    assert top_vectors.top_vectors(frame(spark, []), every=5).collect() == []
    assert top_vectors.top_vectors(frame(spark, rows[:1]), every=5).collect() == []


def test_tree_prunes_and_finds(monkeypatch):
    monkeypatch.setattr(top_vectors, "PAGE", 32)
    rng = np.random.default_rng(5)
    mids = rng.integers(-200, 200, (40, 6))
    v = np.concatenate([m + rng.integers(-8, 9, (100, 6)) for m in mids]).astype(np.int64)
    top = int((v * v).sum(axis=1).max())
    ids = rng.permutation(len(v))
    tree = top_vectors.MTree(v, ids, ids, top)
    # A page's radius covers all below it, and the distances to the parent are those of the objects.
    def rows_of(p):
        if p.children:
            below = np.concatenate([rows_of(c) for c in p.children])
            for c in p.children:
                assert abs(tree._apart(np.array([c.at]), p.at)[0] - c.to_parent) < 1e-6
        else:
            below = p.rows
        assert (tree._apart(below, p.at) <= p.radius + 1e-6).all()
        return below
    assert sorted(rows_of(tree.root)) == list(range(len(v)))
    q = v[:50]
    tree.computed = 0
    score, found = tree.search(q, np.full(50, -1), 5, np.full(50, top_vectors.NO_SCORE))
    s = q @ v.T
    for k in range(50):
        order = np.lexsort((ids, -s[k]))[:5]
        assert score[k].tolist() == s[k][order].tolist() and tree.ids[found[k]].tolist() == ids[order].tolist()
    assert tree.computed < 0.6 * s.size


def test_extensions_of_a_grammar():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = int(rng.integers(1, 60))
        s = rng.integers(0, int(rng.integers(1, 4)), n)
        if rng.random() < 0.5:
            s = np.tile(s[:max(1, n // 5)], 9)[:n]
        s = np.append(s, 9)
        n = len(s) - 1
        pairs = [(a, b) for a in range(n + 1) for b in range(n + 1) if a != b]
        if pairs:
            a, b = np.array(pairs).T
            want = [next(k for k in range(n + 2) if max(i, j) + k > n or s[i + k] != s[j + k]) for i, j in pairs]
            assert Grammar(s).extension(a, b).tolist() == want


def plain_runs(w, least=6, e=4):
    out = {}
    for q in range(1, int(len(w) / e) + 1):
        i = 0
        while i + q < len(w):
            if w[i] == w[i + q]:
                j = i
                while j + q < len(w) and w[j] == w[j + q]:
                    j += 1
                if j - i + q >= max(least, e * q):
                    out.setdefault((i, j - i + q), q)
                i = j
            i += 1
    return sorted((s, n, q) for (s, n), q in out.items())


@pytest.mark.parametrize("least,e", [(6, 4), (2, 2), (4, 2.5), (6, 3)])
def test_runs_against_every_period(least, e):
    rng, some = np.random.default_rng(7), 0
    for _ in range(60):
        texts = []
        for _ in range(6):
            n = int(rng.integers(0, 80))
            s = rng.integers(0, int(rng.integers(1, 5)), n)
            for _ in range(3):
                if n > 10 and rng.random() < 0.7:
                    a, p = int(rng.integers(0, n)), int(rng.integers(1, 9))
                    size = int(rng.integers(0, n - a)) + 1
                    s[a:a + size] = np.tile(s[a:a + p], size)[:size]
            texts.append(s)
        got = list(zip(*(c.tolist() for c in word_runs(texts, least, e))))
        want = [(k, *r) for k, s in enumerate(texts) for r in plain_runs(s.tolist(), least, e)]
        assert got == want
        some += len(want)
    assert some > 100


def report(i, text):
    w = data.words(text)
    n = len(w)
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    found = plain_runs(w)
    gone = {k for s, size, q in found for k in range(s + q, s + size)}
    top = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (i, len(found), *top, 1000 * top[1] // top[2] if found else None, sha("".join(f"{s},{size},{q}\n" for s, size, q in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_run_report_against_every_period(spark):
    rng = random.Random(8)
    rows = data.rows()
    rows += [(30_000 + k, data.prose(rng, rng.randrange(0, 90)), *[None] * 6) for k in range(120)]
    rows += [(None, "a b " * 9, *[None] * 6), (40_000, "go " * 5, *[None] * 6), (40_001, "go " * 6, *[None] * 6), (40_002, "x y z " * 4 + "x", *[None] * 6), (40_003, "one two\x1c three " * 5, *[None] * 6)]
    d = data.table(spark, rows)
    got = run_report(d)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted((report(r[0], r[1]) for r in rows), key=str)
    assert got.where("n_runs > 0").count() > 10
    assert run_report(d.limit(0)).collect() == []


def test_runs_of_very_long_texts(spark):
    rng = random.Random(9)
    texts = ["word " * 200_000, " ".join(["a b c d e f g"] * 30_000), data.prose(rng, 150_000) + " x y" * 10, data.prose(rng, 3)]
    got = {r.id: r for r in periodic_runs(data.docs_of(spark, list(enumerate(texts)))).collect()}
    assert [tuple(r) for r in got[0].runs] == [(0, 200_000, 1)] and got[0].collapsed == "word"
    assert [tuple(r) for r in got[1].runs] == [(0, 210_000, 7)] and got[1].collapsed == "a b c d e f g"
    assert [tuple(r) for r in got[2].runs] == [(150_000, 20, 2)] and got[2].n_words == 150_020
    assert got[3].runs == [] and got[3].collapsed == texts[3]
    assert runs.planted(None, ["a"]) == ["a"]
