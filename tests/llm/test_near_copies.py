"""SimHash near-dedup, connected components and fuzzy lines against brute force."""
import collections
import random

import numpy as np
import pytest
import xxhash

from barloom.llm import line_dedup, simhash
from barloom.llm.components import components
from tests.llm import data


def union(n, pairs):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(500, 560)] + [(700, k) for k in range(701, 1000)] + [(5, 5)]
    want = union(1000, pairs)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    alone = {k for k in range(1000) if not any(k in p and p[0] != p[1] for p in pairs)}
    assert got == {k: want[k] for k in range(1000) if k not in alone}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_fingerprint(t):
    w = data.words(data.lower(t))
    if not w:
        return 0
    hs = [xxhash.xxh64(" ".join(w[i:i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_near_report(spark):
    rng = random.Random(2)
    near = []
    for k in range(12):
        w = data.prose(rng, 400).split()
        for c in range(6):
            v = list(w)
            v[rng.randrange(400)] = f"new{c}"
            near.append((10000 + 10 * k + c, " ".join(v), None, None, None, None, None, None))
    rows = data.rows() + near
    fps = [plain_fingerprint(r[1]) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4]
    tops = union(len(rows), links)
    least = {}
    for top, r in zip(tops, rows):
        if r[0] is not None:
            least[top] = min(least.get(top, r[0]), r[0])
    want = collections.Counter((r[0], f"{f:016x}", least.get(top)) for r, f, top in zip(rows, fps, tops))
    d = data.table(spark, rows)
    assert collections.Counter(map(tuple, simhash.near_report(d).collect())) == want
    assert len(links) > 20
    kept = simhash.near_dedup(d)
    assert kept.columns == d.columns and kept.count() == len(set(tops))
    assert simhash.near_report(data.table(spark, [])).count() == 0 and simhash.near_dedup(data.table(spark, [])).count() == 0


@pytest.mark.parametrize("blocks", [1, 3])
def test_tree_links_connect_what_pairs_connect(spark, blocks):
    rng = np.random.default_rng(3)
    random_ = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    crowd = np.full(400, random_[0])
    for k in range(400):
        for b in rng.integers(0, 64, rng.integers(1, 4)):
            crowd[k] ^= np.uint64(1) << np.uint64(b)
    chain = [random_[1]]
    for k in range(15):
        chain.append(chain[-1] ^ np.uint64(0xF << 4 * k))
    fps = np.unique(np.concatenate([random_, crowd, np.array(chain, np.uint64)]))
    pairs = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4, 1))
    want = union(len(fps), pairs.tolist())
    d = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").repartition(4)
    links = simhash.hamming_links(d, 4, blocks=blocks).collect()
    at = {int(x): k for k, x in enumerate(fps.view(np.int64))}
    assert union(len(fps), [(at[r.u], at[r.v]) for r in links]) == want
    assert all(bin((r.u ^ r.v) & (1 << 64) - 1).count("1") <= 64 for r in links) and len(links) < 40 * len(fps)


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def word_fingerprint(norm):
    hs = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in set(norm.split())]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints_of_lines_of_any_length():
    rng = random.Random(8)
    norms = ["one", data.prose(rng, 9), " ".join(f"w{k}" for k in range(100000)), "one two", "one"]
    fps, pairs = line_dedup.line_fingerprints(norms)
    assert [int(x) & (1 << 64) - 1 for x in fps] == [word_fingerprint(x) for x in norms]
    for k, n in enumerate(norms):
        assert [f[0] for f in line_dedup.line_fingerprints([n])] == [fps[k], pairs[k]]


def test_edit_distance():
    rng = random.Random(11)
    for _ in range(300):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(0, 30)))
        b = list(a)
        for _ in range(rng.randrange(0, 12)):
            k = rng.randrange(0, len(b) + 1)
            b[k:k + rng.choice([0, 1])] = rng.choice([[], ["x"], ["a", "b"]])
        b = "".join(b)
        assert line_dedup.edit_distance(a, b) == edit(a, b)
        a, b = a.replace("b", " "), b.replace("b", " ")
        assert line_dedup.similar(a, b, 0.8) == (edit(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9)


def line_corpus():
    rng = random.Random(7)
    base = [data.prose(rng, 30) for _ in range(40)]
    rows = []
    for k in range(60):
        lines = []
        for _ in range(6):
            line = rng.choice(base)
            w = line.split()
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                w[rng.randrange(len(w))] = f"ed{rng.randrange(99)}"
            lines.append(rng.choice(["", "  "]) + " ".join(w).replace(" ", rng.choice([" ", "  "])))
        lines += ["", "own line %d of a text" % k]
        rows.append((1000 - k, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("meet", [3])
def test_line_groups(spark, monkeypatch, meet):
    monkeypatch.setattr(line_dedup, "MEET", meet)
    rows = line_corpus()
    d = data.docs_of(spark, rows)
    norms = sorted({line_dedup.normalised(x) for _, t in rows for x in t.split("\n")} - {""})
    links = [(i, j) for i in range(len(norms)) for j in range(i) if line_dedup.similar(norms[i], norms[j], 0.8)]  # itself held against a table of edits
    group = dict(zip(norms, union(len(norms), links)))
    first = {}
    for i, t in sorted(rows):
        for pos, line in enumerate(t.split("\n")):
            n = line_dedup.normalised(line)
            if n:
                first.setdefault(group[n], (i, pos))
    want = {}
    for i, t in rows:
        want[i] = "\n".join(x for pos, x in enumerate(t.split("\n")) if not line_dedup.normalised(x) or first[group[line_dedup.normalised(x)]] == (i, pos))
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(d).collect()}
    assert got == want
    assert len(links) > 50


def test_line_dedup_of_awkward_rows(spark):
    d = data.table(spark)
    out = line_dedup.line_dedup(d, count="n_gone", length_col="n_chars")
    assert out.columns == [*d.columns, "n_gone"] and out.count() == d.count()
    rows = out.collect()
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(r[0] for r in data.rows())
    assert sum(r.text is None for r in rows) == sum(r[1] is None for r in data.rows())
    assert all(r.text is None or r.n_chars == len(r.text) for r in rows)
    left = collections.Counter(line_dedup.normalised(x) for r in rows for x in (r.text or "").split("\n"))
    del left[""]
    assert set(left.values()) == {1}
    assert line_dedup.line_dedup(data.table(spark, [])).count() == 0


def test_a_crowd_of_similar_lines_keeps_one(spark):
    rng = random.Random(9)
    w = data.prose(rng, 80).split()
    rows = []
    for k in range(300):
        v = list(w)
        v[rng.randrange(80)] = f"x{k}"
        rows.append((k, " ".join(v)))
    out = line_dedup.line_dedup(data.docs_of(spark, rows)).collect()
    assert sum(bool(r.text) for r in out) <= 3 and next(r.text for r in out if r.doc_id == 0) == rows[0][1]
