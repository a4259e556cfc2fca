"""Periodic runs of words, by recompression.

A batch of texts becomes one string of word numbers, texts parted by numbers of their own. Rounds of block compression (a
stretch of one symbol becomes one) and pair compression (symbols fall into left and right, every left one before a right
one joins it) turn it level by level into a run-length grammar in which equal stretches parse alike but for their ends.
The longest common extension of two places climbs the levels while it stands at the beginning of equal symbols and
comes down where they differ: a few steps a level, for all questions of a batch at once.

A run of period q and at least e periods holds one of the places 0, q, 2q, ... within its first q words, from where more than
(e - 2) q words repeat after q. These places of all periods, of which there are about n ln n, are the candidates; a few equal words
are asked for before the grammar gives the exact extension to the right and, over the reversed string, to the left.
"""
from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import SPACE, text_of

WORD = re.compile("[^" + SPACE[1:-1] + "]+")
TOGETHER = 1 << 17  # words of texts that share a grammar; a longer text has its own
PAIRS = 1 << 21  # candidates that are looked at together


@dataclass
class Level:
    """Symbols of a level and how they form those of the next: ``parent`` of each, ``first`` child of each parent."""

    symbols: np.ndarray
    blocks: bool = False
    parent: np.ndarray | None = None
    first: np.ndarray | None = None  # and, behind the last, the number of symbols


def _renamed(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].reshape(-1)


class Grammar:
    """Levels over ``symbols``, which must end in a symbol that occurs nowhere else."""

    def __init__(self, symbols: np.ndarray):
        self.levels = [Level(_renamed(symbols))]
        blocks = True
        while True:
            level = self.levels[-1]
            s = level.symbols
            most = int(s.max()) + 1
            if most == len(s):  # no symbol occurs twice
                return
            begins = np.ones(len(s), bool)
            if blocks:
                begins[1:] = s[1:] != s[:-1]
            else:
                right = ((np.arange(most, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(len(self.levels))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(63)).astype(bool)[s]
                up, down = ~right[:-1] & right[1:], right[:-1] & ~right[1:]
                begins[1:] = ~(up if np.count_nonzero(up) >= np.count_nonzero(down) else down)
            blocks = not blocks
            first = np.flatnonzero(begins)
            if len(first) == len(s):
                continue
            level.blocks = not blocks
            level.parent = np.cumsum(begins) - 1
            level.first = np.append(first, len(s))
            size = np.diff(level.first)
            name = s[first]
            more = name * (len(s) + 1) + size if level.blocks else name * most + s[np.minimum(first + 1, len(s) - 1)]
            self.levels.append(Level(_renamed(np.where(size == 1, name, most + more))))

    def _step(self, level: Level, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols two places that hold the same one pass: the rest of the shorter stretch, or one."""
        if not level.blocks:
            return np.ones(len(a), np.int64)
        return np.minimum(level.first[level.parent[a] + 1] - a, level.first[level.parent[b] + 1] - b)

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of different places how many symbols from there on are equal."""
        start, top = a, len(self.levels) - 1
        a, b = a.copy(), b.copy()
        height = np.full(len(a), top)  # of the level at which the two differ
        up = np.arange(len(a))
        for h, level in enumerate(self.levels[:-1]):
            x, y = a[up], b[up]
            same = level.symbols[x] == level.symbols[y]
            height[up[~same]] = h
            up, x, y = up[same], x[same], y[same]
            inside = (level.first[level.parent[x]] != x) | (level.first[level.parent[y]] != y)
            at = np.flatnonzero(inside)
            if len(at):
                n = self._step(level, x[at], y[at])
                x[at] += n
                y[at] += n
                # Stretches of different lengths end apart.
                ends = (level.first[level.parent[x[at]]] == x[at]) & (level.first[level.parent[y[at]]] == y[at])
                apart = at[~ends]
                height[up[apart]], a[up[apart]], b[up[apart]] = h, x[apart], y[apart]
                keep = np.ones(len(x), bool)
                keep[apart] = False
                up, x, y = up[keep], x[keep], y[keep]
            a[up], b[up] = level.parent[x], level.parent[y]
        for h in range(top - 1, -1, -1):
            level = self.levels[h]
            below = np.flatnonzero(height > h)
            a[below], b[below] = level.first[a[below]], level.first[b[below]]
            at = np.flatnonzero(height >= h)
            while True:
                at = at[level.symbols[a[at]] == level.symbols[b[at]]]
                if not len(at):
                    break
                n = self._step(level, a[at], b[at])
                a[at] += n
                b[at] += n
        return a - start


def _candidates(symbols: np.ndarray, begin: np.ndarray, size: np.ndarray, exponent: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place, period) of the places of every period's grid from where some words, spread over the distance asked for, repeat."""
    most = (size / exponent).astype(np.int64)
    text = np.repeat(np.arange(len(size)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    reach = ((exponent - 2) * period).astype(np.int64)  # so many words after the place repeat, and one
    count = np.maximum((size[text] - 1 - period - reach) // period + 1, 0)
    total = np.cumsum(count)
    at = 0
    while at < len(text):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right")))
        of = np.repeat(np.arange(at, end), count[at:end])
        place = (np.arange(len(of)) - np.repeat(np.cumsum(count[at:end]) - count[at:end], count[at:end])) * period[of] + begin[text[of]]
        for part in (0, 4, 2, 1, 3):  # quarters of the distance
            if not len(of):
                break
            i = place + reach[of] * part // 4
            same = symbols[i] == symbols[i + period[of]]
            of, place = of[same], place[same]
        yield text[of], place, period[of]
        at = end


def word_runs(texts: Sequence[np.ndarray], min_length: int = 6, exponent: float = 4.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of every run, ordered; ``texts``: the words' numbers, from 0."""
    none = np.empty(0, np.int64)
    size = np.array([len(t) for t in texts], np.int64)
    highest = max((int(t.max()) for t in texts if len(t)), default=0) + 1

    def joined(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts in one string, before and after each a number of its own; where each begins."""
        parts = [np.array([highest])]
        for k, t in enumerate(own):
            parts += [texts[t], np.array([highest + 1 + k])]
        return np.concatenate(parts), np.cumsum(size[own] + 1) - size[own]

    symbols, begin = joined(np.arange(len(texts)))
    found = [c for c in _candidates(symbols, begin, size, exponent) if len(c[0])]
    if not found:
        return none, none, none, none
    text, place, period = (np.concatenate(c) for c in zip(*found))
    own, of = np.unique(text, return_inverse=True)  # texts without a candidate need no grammar
    place = place - begin[text]
    symbols, begin = joined(own)
    place = place + begin[of]
    right = Grammar(symbols).extension(place, place + period)
    long = right > ((exponent - 2) * period).astype(np.int64)
    of, place, period, right = of[long], place[long], period[long], right[long]
    if not len(of):
        return none, none, none, none
    last = len(symbols) - 1
    # Reversed, the string ends in the number before the first text. Places before the candidate, going left.
    left = Grammar(symbols[::-1].copy()).extension(last - (place + period - 1), last - (place - 1))
    start, length = place - left - begin[of], left + right + period
    enough = length >= np.maximum(min_length, exponent * period)
    runs = np.unique(np.stack([own[of], start, length, period], axis=1)[enough], axis=0)
    # Of one stretch the smallest period is its own.
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :3] != runs[:-1, :3]).any(axis=1)
    runs = runs[first]
    return tuple(runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))].T)


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _found(batches: Iterator[pa.RecordBatch], min_length: int, exponent: float, edit: Callable | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column("id").to_pylist(), batch.column("t")
        at = 0
        while at < len(ids):
            words, numbers, names, total, begin = [], [], {}, 0, at
            while at < len(ids) and (at == begin or total < TOGETHER):
                w = WORD.findall(texts[at].as_py())
                if edit is not None:
                    w = edit(ids[at], w)
                words.append(w)
                numbers.append(np.array([names.setdefault(x, len(names)) for x in w], np.int64))
                total += len(w)
                at += 1
            text, start, length, period = word_runs(numbers, min_length, exponent)
            kept = []
            bounds = np.searchsorted(text, np.arange(len(words) + 1))
            for k, w in enumerate(words):
                a, b = bounds[k], bounds[k + 1]
                if a < b:
                    change = np.zeros(len(w) + 1, np.int64)
                    np.add.at(change, start[a:b] + period[a:b], 1)
                    np.add.at(change, start[a:b] + length[a:b], -1)
                    w = [w[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
                kept.append(" ".join(w))
            runs = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(period, pa.int64())], fields=list(RUNS.value_type))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[begin:at], pa.int64()), pa.array([len(w) for w in words], pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), runs), pa.array(kept, pa.string())],
                names=["id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, exponent: float = 4.0, edit: Callable | None = None) -> DataFrame:
    """id, n_words, runs (start, length, period; by start, then period) and collapsed text of every row.

    A run is a stretch of words with smallest period q, at least ``min_length`` words and ``exponent`` (2 or more) periods
    long, that no neighbouring word extends. Collapsed: the words, joined by one space, but those that a run holds after
    its first period. Words are what stands between spaces, tabs and line ends. ``edit(id, words)`` may change the words first. A null or empty text
    has no words and no runs; repeated rows and null ids are rows like others; other columns are not looked at, whatever
    their names. A text is handled whole in one task, whatever its length.
    """
    if exponent < 2:
        raise ValueError("a run has at least two periods")
    d = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("t"))
    return d.mapInArrow(lambda it: _found(it, min_length, exponent, edit), "id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(id_: int | None, words: list[str]) -> list[str]:
    """The words with a periodic tail where the id's CRC-32 is divisible by ten; null ids and empty texts as they are."""
    h = zlib.crc32(str(id_).encode()) if id_ is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * -(-(n - a) // p))[:n - a]


def strongest(runs: Column) -> Column:
    """The run of the greatest length / period, compared exactly; the first of equals."""
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    return F.aggregate(runs, none, lambda best, r: F.when(better(best, r), r).otherwise(best))


def run_report(docs: DataFrame, **options) -> DataFrame:
    """Digests of ``periodic_runs`` with planted tails: doc_id, n_runs, the strongest run, runs_sha256, collapsed_sha256."""
    d = periodic_runs(docs, edit=planted, **options).withColumn("best", strongest(F.col("runs")))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return d.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
