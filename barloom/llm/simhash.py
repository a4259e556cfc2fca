"""SimHash near-dedup of whole documents over vantage-point trees.

Random 64-bit fingerprints lie 32 +- 4 bits from any vantage point, so at a radius of a few bits a tree over all 64
bits prunes next to nothing. The trees here measure Hamming distance on three blocks of bits: of two fingerprints that
differ in at most r bits, at least one block differs in at most r // 3, and that block's tree finds the pair with this
smaller radius. A node of a tree is a vantage value and a radius; the triangle bound says which sides a query ball
reaches. The upper part of each tree, built from a bounded sample, deals fingerprints to shards: a fingerprint is a
member of one shard and a visitor of every shard its ball overlaps. Inside a shard the tree goes on over the rows at
hand, and the leaves compare all 64 bits.

Copies are one fingerprint from the start. A leaf reports which of its rows hang together, a row each, not its pairs.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import partitions, stored, text_of
from barloom.llm.components import components

BITS = 64
BLOCKS = 3
LEAF = 64  # members of a leaf that are compared with all its visitors
SAMPLE_PER_SHARD = 32
FINGERPRINTS = "row long, id long, fp long"


def shingle_hashes(text: str, shingle: int, seed: int = 42) -> np.ndarray:
    """A hash for each run of ``shingle`` lower-cased (A-Z) words, in their order; a shorter text is one run."""
    words = text.encode("utf-8").lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1:].tolist())
    return np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, len(words) - k + 1)


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of the shingles of lower-cased (A-Z) words; 0 without words."""
    hashes = shingle_hashes(text, shingle, seed)
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at:at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_ = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(set_.view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = [fingerprint(t, shingle, seed) for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)) for t in part.column("t").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["row", "id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """row (place in ``docs``), id, fp (64 bits as a long) for every row; null text: 0."""
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("t"))
    return d.mapInArrow(lambda it: _fingerprints(it, shingle, seed), FINGERPRINTS)


def block_masks(blocks: int = BLOCKS) -> list[int]:
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]


def _distance(values: np.ndarray, vantage: np.uint64, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((values ^ vantage) & mask)


def _split(values: np.ndarray, mask: np.uint64, rng: np.random.Generator) -> tuple[np.uint64, int, np.ndarray] | None:
    """A vantage value and a radius that halve ``values``, with their distances; None where all lie in one place.

    Of a few candidates the one whose ball and complement are nearest to equal, weighed against crowded boundaries.
    """
    best = None
    for vantage in values[rng.integers(0, len(values), 4)]:
        d = _distance(values, vantage, mask)
        count = np.bincount(d, minlength=BITS + 1)
        inside = np.cumsum(count)
        if inside[0] == len(values):
            continue
        cost = np.maximum(inside, len(values) - inside) + (count + np.append(count[1:], 0)) / 2
        cost[inside == len(values)] = len(values) * 4.0
        radius = int(np.argmin(cost))
        if best is None or cost[radius] < best[0]:
            best = (cost[radius], vantage, radius, d)
    return best and best[1:]


class Tree:
    """The upper part of a vantage-point tree: parallel lists over its nodes; a negative child is a shard."""

    def __init__(self, sample: np.ndarray, mask: int, shards: int, seed: int):
        self.mask, self.vantage, self.radius, self.inner, self.outer, self.shards = np.uint64(mask), [], [], [], [], 0
        rng = np.random.default_rng(seed)
        self.root = self._build(sample, max(1, len(sample) // max(shards, 1)), rng)

    def _build(self, values: np.ndarray, size: int, rng: np.random.Generator) -> int:
        cut = _split(values, self.mask, rng) if len(values) > size else None
        if cut is None:
            self.shards += 1
            return -self.shards
        vantage, radius, d = cut
        at = len(self.vantage)
        self.vantage.append(vantage)
        self.radius.append(radius)
        self.inner.append(0)
        self.outer.append(0)
        self.inner[at] = self._build(values[d <= radius], size, rng)
        self.outer[at] = self._build(values[d > radius], size, rng)
        return at

    def visits(self, values: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, places in ``values``) for every shard that a ball of ``reach`` bits around a value overlaps."""
        todo = [(self.root, np.arange(len(values)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if node < 0:
                yield -node - 1, at
                continue
            d = _distance(values[at], self.vantage[node], self.mask).astype(np.int64)
            todo.append((self.inner[node], at[d - reach <= self.radius[node]]))
            todo.append((self.outer[node], at[d + reach > self.radius[node]]))


def _dealt(batches: Iterator[pa.RecordBatch], trees: list[Tree], reach: int) -> Iterator[pa.RecordBatch]:
    first = np.concatenate(([0], np.cumsum([t.shards for t in trees])))
    for batch in batches:
        values = batch.column("fp").to_numpy().view(np.uint64)
        for k, tree in enumerate(trees):
            home = np.zeros(len(values), np.int64)
            for shard, at in tree.visits(values, 0):
                home[at] = shard
            for shard, at in tree.visits(values, reach):
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, first[k] + shard, np.int32)), pa.array(np.full(n, k, np.int32)), pa.array(home[at] == shard), pa.array(values[at].view(np.int64))],
                    names=["shard", "tree", "member", "fp"])


def _hung(adjacent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of members x visitors: for each visitor and each member the first member of its connected part, -1 without one."""
    none = adjacent.shape[0]
    label = np.arange(none)
    while True:
        of_visitor = np.where(adjacent, label[:, None], none).min(axis=0)
        new = np.minimum(label, np.where(adjacent, of_visitor[None, :], none).min(axis=1))
        new = new[new]
        if (new == label).all():
            return np.where(of_visitor == none, -1, of_visitor), label
        label = new


def shard_links(members: np.ndarray, visitors: np.ndarray, mask: int, reach: int, most: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of fingerprints that connect exactly what the links (at most ``most`` bits) of members with visitors connect."""
    mask, rng = np.uint64(mask), np.random.default_rng(seed)
    a, b = [], []
    todo = [(members, visitors)]
    while todo:
        m, v = todo.pop()
        if not len(m) or not len(v):
            continue
        cut = _split(m, mask, rng) if len(m) > LEAF else None
        if cut is not None:
            vantage, radius, d = cut
            dv = _distance(v, vantage, mask).astype(np.int64)
            todo.append((m[d <= radius], v[dv - reach <= radius]))
            todo.append((m[d > radius], v[dv + reach > radius]))
            continue
        # A leaf, or values that agree on the whole block: compared in pieces of bounded size.
        for at in range(0, len(m), LEAF):
            part = m[at:at + LEAF]
            for to in range(0, len(v), 1 << 13):
                w = v[to:to + (1 << 13)]
                apart = np.bitwise_count(part[:, None] ^ w[None, :])
                near = apart <= most
                if np.count_nonzero(near) == np.count_nonzero(apart == 0):  # each only to itself
                    continue
                some = near.any(axis=0)
                of_visitor, of_member = _hung(near[:, some])
                a += [w[some], part]
                b += [part[of_visitor], part[of_member]]
    if not a:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    a, b = np.concatenate(a), np.concatenate(b)
    return a[a != b], b[a != b]


def _links(group: pa.Table, masks: list[int], reach: int, most: int) -> pa.Table:
    shard, tree = group.column("shard")[0].as_py(), group.column("tree")[0].as_py()
    values = group.column("fp").to_numpy().view(np.uint64)
    member = group.column("member").to_numpy(zero_copy_only=False)
    order = np.argsort(values, kind="stable")
    values, member = values[order], member[order]
    a, b = shard_links(values[member], values, masks[tree], reach, most, shard)
    return pa.Table.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["u", "v"])


def hamming_links(fps: DataFrame, most: int = 4, blocks: int = BLOCKS, seed: int = 42) -> DataFrame:
    """(u, v): links that connect exactly the fingerprints that links of at most ``most`` bits connect.

    ``fps``: column fp, distinct. The trees' upper parts come from at most ``SAMPLE_PER_SHARD`` values a shard, with
    about two shards a partition over all trees.
    """
    spark = fps.sparkSession
    masks, reach = block_masks(blocks), most // blocks
    shards = max(1, -(-2 * partitions(spark) // blocks))
    rows = fps.count()
    share = min(1.0, SAMPLE_PER_SHARD * shards / max(rows, 1))
    sample = np.array([r[0] for r in fps.select("fp").sample(share, seed).collect()], np.int64).view(np.uint64)
    trees = [Tree(np.sort(sample), m, shards, seed + k) for k, m in enumerate(masks)]
    dealt = fps.select("fp").mapInArrow(lambda it: _dealt(it, trees, reach), "shard int, tree int, member boolean, fp long")
    return dealt.groupBy("shard").applyInArrow(lambda g: _links(g, masks, reach, most), "u long, v long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, most: int = 4, seed: int = 42) -> DataFrame:
    """row, id, fp and component_id (the smallest id that links of at most ``most`` bits reach) of every row.

    Texts without words, null or empty, have fingerprint 0 and link like any other. Repeated rows share a component;
    one with null ids alone has component_id null. An empty table gives no rows.
    """
    rows = stored(fingerprints(docs, id_col, text_col, shingle, seed))
    distinct = stored(rows.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(hamming_links(distinct, most, seed=seed))
    distinct = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = distinct.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(distinct.join(least, "root").select("fp", "component_id", "root"), "fp")


def near_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row; see ``near_groups``."""
    found = near_groups(docs, **options)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` with one row of each component: the first of its smallest id."""
    found = near_groups(docs, id_col, text_col, **options)
    keep = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row")).alias("first")).select("first.row")
    packed = docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc"))
    return packed.join(keep, "row", "left_semi").select("doc.*")
