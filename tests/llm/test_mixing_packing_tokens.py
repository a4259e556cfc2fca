"""Mixing, packing and token counts: brute force, exact sums and round trips."""
import collections
import itertools
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from barloom.llm import mixing, packing, token_counts
from barloom.llm.tokens import encoder
from tests.llm import data


def test_knapsack_is_exact():
    rng = random.Random(1)
    for _ in range(200):
        lengths = rng.sample(range(1, 40), rng.randrange(1, 5))
        free = [rng.randrange(0, 4) for _ in lengths]
        budget = rng.randrange(0, 90)
        used = mixing.knapsack(lengths, free, budget)
        assert all(0 <= u <= n for u, n in zip(used, free))
        sums = {sum(a * k for a, k in zip(lengths, c)) for c in itertools.product(*[range(n + 1) for n in free])}
        assert abs(sum(a * int(u) for a, u in zip(lengths, used)) - budget) == min(abs(s - budget) for s in sums)


@pytest.mark.parametrize("rest", [2000, 65536])
def test_fit_budget_is_near(rest):
    rng = random.Random(2)
    for _ in range(50):
        lengths = sorted(rng.sample(range(0, 500), 60) + [1])
        lengths = sorted(set(lengths))
        counts = [rng.randrange(1, 30) for _ in lengths]
        total = sum(a * n for a, n in zip(lengths, counts))
        budget = rng.randrange(0, total + 1)
        taken = mixing.fit_budget(lengths, counts, budget, rest)
        assert all(0 <= t <= n for t, n in zip(taken, counts))
        assert abs(sum(a * t for a, t in zip(lengths, taken)) - budget) <= 1


def shares(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        level = (total - sum(fixed.values())) / sum(w[s] for s in free)
        above = [s for s in free if w[s] * level > cap * sizes[s]]
        if not above:
            return {**fixed, **{s: w[s] * level for s in free}}
        fixed |= {s: cap * sizes[s] for s in above}


def test_mix_report(spark):
    rows = [r for r in data.rows()]
    rng = random.Random(4)
    rows += [(10**9 + k, data.prose(rng, rng.randrange(1, 60)), "en", rng.choice(["a", "b", "zz", "zz", "zz", None]), 1, None, None, None) for k in range(400)]
    out = mixing.mix_report(data.table(spark, rows)).collect()
    assert collections.Counter((r.doc_id, r["size"]) for r in out) == collections.Counter((r[0], len(data.words(r[1]))) for r in rows)
    sizes, by_id = collections.Counter(), {}
    for r in rows:
        sizes[r[3]] += len(data.words(r[1]))
        by_id[r[0]] = r[3]
    want, taken = shares(dict(sizes)), collections.Counter()
    for r in out:
        assert r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        if r.doc_id is not None:
            assert r.source_size == sizes[by_id[r.doc_id]] and r.target == pytest.approx(want[by_id[r.doc_id]])
        taken[(r.source_size, r.target)] += r.taken
    assert len(taken) == len(sizes)
    for (size, target), n in taken.items():  # as near as any choice of documents comes
        own, sums = [len(data.words(r[1])) for r in rows if sizes[r[3]] == size], {0}
        for k in own:
            sums |= {s + k for s in sums}
        assert abs(n - target) <= min(abs(target // size * size + s - target) for s in sums) + 1
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    again = mixing.mix_report(data.table(spark, rows).repartition(5)).collect()
    assert collections.Counter(map(tuple, again)) == collections.Counter(map(tuple, out))


def test_mixed_rows(spark):
    d = data.table(spark)
    out = mixing.mixed(d)
    assert out.columns == d.columns
    plan = {(r.doc_id, r["size"]): 0 for r in mixing.mix_plan(d).collect()}
    for r in mixing.mix_plan(d).collect():
        plan[(r.doc_id, r["size"])] += r.copies
    got = collections.Counter((r.doc_id, len(data.words(r.text))) for r in out.collect())
    assert got == collections.Counter({k: n for k, n in plan.items() if n})
    assert mixing.mix_report(data.table(spark, [])).count() == 0 and mixing.mixed(data.table(spark, [])).count() == 0


def test_same_ids_as_the_vocabulary_file():
    enc = encoder()
    slow = Tokenizer.from_file(enc.json)
    odd = ["<|endoftext|>", "a<|endoftext|>b", " \n\n x\t", "it's  I'M", "😀é\u00a0 ", "x" * 5000, "\x00\x01", "१२३ 漢字", " " * 3000]
    for t in [t or "" for t in data.texts()] + odd:
        assert enc.ids(t).tolist() == slow.encode(t, add_special_tokens=False).ids


def test_first_fit_against_a_plain_scan():
    rng = random.Random(3)
    for _ in range(30):
        sizes = [rng.randrange(1, 101) for _ in range(rng.randrange(1, 120))]
        plain = []
        for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
            at = next((b for b in plain if sum(sizes[i] for i in b) + sizes[k] <= 100), None)
            if at is None:
                plain.append(at := [])
            at.append(k)
        bins = packing.first_fit(sizes, 100)
        assert [[k for k, _, _ in b] for b in bins] == plain
        closed = packing.close_up(bins, 128)
        fill = [sum(p[2] for p in b) for b in closed]
        assert all(n == 128 or n & (n - 1) == 0 for n in fill) and sum(fill) == sum(sizes)
        pieces = collections.defaultdict(list)
        for b in closed:
            for k, start, size in b:
                pieces[k].append((start, size))
        for k, got in pieces.items():
            assert [s for s, _ in sorted(got)] == [sum(n for _, n in sorted(got)[:i]) for i in range(len(got))] and sum(n for _, n in got) == sizes[k]


@pytest.mark.parametrize("group_docs", [7, 2048])
def test_packing_round_trip(spark, group_docs):
    out = packing.packed(data.table(spark), group_docs=group_docs).collect()
    slow = Tokenizer.from_file(encoder().json)
    want = collections.Counter()
    whole = collections.defaultdict(list)
    for r in data.rows():
        ids = np.array(slow.encode(r[1] or "", add_special_tokens=False).ids + [0], dtype="<u4")
        whole[(r[0], len(ids))].append(ids)
    got = collections.defaultdict(list)
    for r in out:
        got[(r.doc_id, r.doc_tokens)].append(r)
    assert set(got) == set(whole)
    for key, docs in whole.items():
        assert sum(r.length for r in got[key]) == key[1] * len(docs)
        for r in got[key]:  # copies share id and length; texts of one id and length are equal here
            assert any(zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32 for ids in docs)
        starts = collections.Counter(r.start for r in got[key])
        assert starts[0] == len(docs)
    sequences = collections.defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == 1024 or at & (at - 1) == 0 and at < 1024
    assert packing.packed(data.table(spark, [])).count() == 0


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_tokens(spark, rule):
    rows = [(k, t) for k, t in enumerate(data.texts())] + [(900, "a\n\n\nb  \n c\n"), (901, "é\n😀😀\n漢字漢字\nx"), (902, "don't\nstop" * 20)]
    sep = "o" if rule != "first" else "\n"
    out = collections.defaultdict(list)
    for r in token_counts.section_tokens(data.docs_of(spark, rows), separator=sep, rule=rule).collect():
        out[r.doc_id].append(r)
    slow = Tokenizer.from_file(encoder().json)
    for i, t in rows:
        t = t or ""
        pieces = t.split(sep)
        pieces = [p + sep for p in pieces[:-1]] + pieces[-1:]
        owner = [k for k, p in enumerate(pieces) for _ in p.encode()]
        n, at = collections.Counter(), 0
        for k in slow.encode(t, add_special_tokens=False).ids:
            size = int(encoder().n_bytes[k])
            own = owner[at:at + size]
            at += size
            n[{"first": own[0], "last": own[-1], "most": collections.Counter(own).most_common(1)[0][0]}[rule]] += 1
        assert at == len(t.encode())
        got = sorted(out[i], key=lambda r: r.section)
        assert [r.section for r in got] == list(range(len(pieces))) and [r.n_tokens for r in got] == [n[k] for k in range(len(pieces))]
        assert [t[r.start:r.end] for r in got] == pieces


def test_field_tokens(spark):
    d = data.table(spark)
    out = token_counts.section_tokens(d, fields=("lang", "text", "source"))
    assert out.count() == 3 * d.count()
    assert token_counts.section_tokens(data.table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        token_counts.section_tokens(d, rule="none")
