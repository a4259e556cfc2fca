"""Packing documents into token sequences by first-fit decreasing.

Documents are dealt at random into groups of bounded size, each packed in one task of its own. Whole sequences of a
long document stand alone; its tail goes to the first open sequence with room, found through a tournament tree over
the sequences' free room. What stays open at the end of a group is closed up by cutting tails.
"""
from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import text_of
from barloom.llm.tokens import VOCABULARY, encoder

LENGTH = 1024
GROUP_DOCS = 2048
END = 0
SEQUENCES = 1 << 32  # ids per group
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Tournament:
    """Bins of equal room; each inner node holds the most room below it."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.most = [room] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The first bin with room for ``size``, which it then takes."""
        most, k = self.most, 1
        while k < self.leaves:
            k *= 2
            if most[k] < size:
                k += 1
        found = k - self.leaves
        most[k] -= size
        while k > 1:
            k //= 2
            most[k] = max(most[2 * k], most[2 * k + 1])
        return found


def powers(n: int) -> list[int]:
    """The powers of two that sum to ``n``, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def close_up(bins: list[list[tuple[int, int, int]]], length: int) -> list[list[tuple[int, int, int]]]:
    """Bins of (item, start, size) with the same content, all full or a power of two long.

    Pieces of the emptiest bins are cut to fill the room of the fullest; what is left is cut into powers of two.
    """
    fill = [sum(p[2] for p in b) for b in bins]
    out = [b for b, n in zip(bins, fill) if n == length]
    open_ = sorted((k for k, n in enumerate(fill) if n < length), key=lambda k: -fill[k])
    stock = deque(p for k in reversed(open_) for p in bins[k])  # the fullest bin's pieces are last
    room = sum(fill[k] for k in open_)

    def cut(want: int) -> list[tuple[int, int, int]]:
        got = []
        while want:
            item, start, size = stock.popleft()
            got.append((item, start, min(size, want)))
            if size > want:
                stock.appendleft((item, start + want, size - want))
            want -= got[-1][2]
        return got

    for k in open_:
        if room < length:  # then this bin or its rest is the whole stock
            break
        own = [stock.pop() for _ in bins[k]][::-1]
        out.append(own + cut(length - fill[k]))
        room -= length
    return out + [cut(n) for n in powers(room)]


def first_fit(sizes: list[int], length: int) -> list[list[tuple[int, int, int]]]:
    """First-fit decreasing: bins of (item, 0, size); equal sizes in the order given."""
    tree, bins = Tournament(len(sizes), length), []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        b = tree.place(sizes[k])
        if b == len(bins):
            bins.append([])
        bins[b].append((k, 0, sizes[k]))
    return bins


def _encoded(batches: Iterator[pa.RecordBatch], vocabulary: str, length: int) -> Iterator[pa.RecordBatch]:
    enc = encoder(vocabulary)
    for batch in batches:
        for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
            tokens, crcs, tails = [], [], []
            for text in part.column("t").to_pylist():
                ids = np.append(enc.ids(text), np.uint32(END)).astype("<u4")
                whole = len(ids) // length * length
                tokens.append(len(ids))
                crcs.append([zlib.crc32(ids[i:i + length].tobytes()) for i in range(0, whole, length)])
                tails.append(ids[whole:].tobytes())
            columns = [part.column(c) for c in ("pack", "turn", "doc_id")]
            columns += [pa.array(tokens, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(tails, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["pack", "turn", "doc_id", "tokens", "crcs", "tail"])


def _packed(group: pa.Table, length: int) -> pa.Table:
    group = group.sort_by([("turn", "ascending"), ("tokens", "ascending")])
    ids, total, tail = (group.column(c).to_pylist() for c in ("doc_id", "tokens", "tail"))
    rows, sequence = [], group.column("pack")[0].as_py() * SEQUENCES
    for doc, n, crcs in zip(ids, total, group.column("crcs").to_pylist()):
        for k, crc in enumerate(crcs):
            rows.append((doc, k * length, length, crc, n, sequence, 0))
            sequence += 1
    has = [k for k, t in enumerate(tail) if t]
    tails = [np.frombuffer(tail[k], dtype="<u4") for k in has]
    for pieces in close_up(first_fit([len(t) for t in tails], length), length):
        offset = 0
        for k, start, size in pieces:
            n = total[has[k]]
            rows.append((ids[has[k]], n - len(tails[k]) + start, size, zlib.crc32(tails[k][start:start + size].tobytes()), n, sequence, offset))
            offset += size
        sequence += 1
    names = [c.split()[0] for c in PIECES.split(", ")]
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, length: int = LENGTH, group_docs: int = GROUP_DOCS, seed: int = 42) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and a closing 0; null and empty texts are that 0 alone. Each id lies in one piece. Sequences
    hold ``length`` ids, but for at most a few a group that are a power of two long. Repeated rows are documents of
    their own; null ids stay null. An empty table gives no rows. Groups hold about ``group_docs`` documents.
    """
    if length < 1 or group_docs < 1:
        raise ValueError("length and group_docs: 1 or more")
    groups = max(1, -(-docs.count() // group_docs))
    turn = F.xxhash64(F.lit(seed), F.col("doc_id"), F.monotonically_increasing_id())
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t")).withColumn("turn", turn)
    d = d.select("doc_id", "t", "turn", F.pmod("turn", F.lit(groups)).cast("int").alias("pack"))
    coded = d.mapInArrow(lambda it: _encoded(it, vocabulary, length), "pack int, turn long, doc_id long, tokens long, crcs array<long>, tail binary")
    return coded.groupBy("pack").applyInArrow(lambda g: _packed(g, length), PIECES)
