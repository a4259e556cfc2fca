"""Token counts of fields or sections, by attribution of the tokens of the whole document.

A document is encoded once, as a whole. The spans of its tokens and of its sections, both in order, are joined as
intervals; a token that crosses a boundary goes to one section by an explicit rule.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import text_of
from barloom.llm.tokens import VOCABULARY, encoder

RULES = ("first", "last", "most")
OUT = "doc_id long, section long, start long, end long, n_tokens long, n_crossing long"


def attributed(token_bytes: np.ndarray, section_bytes: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(section of each token, whether it crosses a boundary), from the lengths of tokens and sections in bytes.

    rule: the section of the token's first byte, of its last byte, or of most of its bytes (the first on a tie).
    Empty sections own no byte and get no token.
    """
    ends = np.cumsum(token_bytes)
    starts = ends - token_bytes
    bounds = np.cumsum(section_bytes)
    first = np.searchsorted(bounds, starts, side="right")
    last = np.searchsorted(bounds, ends - 1, side="right")
    crossing = first != last
    if rule == "first":
        return first, crossing
    if rule == "last":
        return last, crossing
    best = first.copy()
    lower = bounds - section_bytes
    for k in np.flatnonzero(crossing):
        over = [min(ends[k], bounds[s]) - max(starts[k], lower[s]) for s in range(first[k], last[k] + 1)]
        best[k] = first[k] + int(np.argmax(over))
    return best, crossing


def _counted(batches: Iterator[pa.RecordBatch], names: Sequence[str], separator: str, rule: str, vocabulary: str) -> Iterator[pa.RecordBatch]:
    enc = encoder(vocabulary)
    for batch in batches:
        for part in (batch.slice(i, 128) for i in range(0, batch.num_rows, 128)):
            ids, places, tables = part.column("doc_id"), [], []
            for row, fields in enumerate(zip(*[part.column(n).to_pylist() for n in names])):
                # A section ends with its separator; the last has none.
                pieces = fields[0].split(separator) if len(names) == 1 else list(fields)
                pieces = [p + separator for p in pieces[:-1]] + pieces[-1:]
                chars = np.fromiter(map(len, pieces), np.int64, len(pieces))
                sizes = np.fromiter((len(p.encode("utf-8")) for p in pieces), np.int64, len(pieces))
                tokens = enc.n_bytes[enc.ids("".join(pieces))]
                section, crossing = attributed(tokens, sizes, rule)
                n = np.bincount(section, minlength=len(pieces))
                crossed = np.bincount(section[crossing], minlength=len(pieces))
                end = np.cumsum(chars)
                tables.append(np.stack([np.arange(len(pieces)), end - chars, end, n, crossed]))
                places.append(np.full(len(pieces), row))
            columns = np.concatenate(tables, axis=1) if tables else np.empty((5, 0), np.int64)
            at = np.concatenate(places) if places else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *[pa.array(c, pa.int64()) for c in columns]], names=[c.split()[0] for c in OUT.split(", ")])


def section_tokens(docs: DataFrame, id_col: str = "doc_id", fields: Sequence[str] = ("text",), separator: str = "\n", rule: str = "most", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per document and section: doc_id, section (from 0), start, end (code points), n_tokens, n_crossing.

    One field: its sections are what ``separator`` parts, each with the separator that ends it. Several fields: each is
    a section, joined by ``separator``. The sections' tokens sum to the document's; n_crossing of them reach into
    another section. Null fields count as empty; an empty section has no tokens of its own; an empty document has one
    section of none. Repeated rows are reported each; an empty table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule: one of {RULES}")
    if not separator:
        raise ValueError("separator: one character or more")
    names = [f"f{k}" for k in range(len(fields))]
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[text_of(c).alias(n) for c, n in zip(fields, names)])
    return d.mapInArrow(lambda it: _counted(it, names, separator, rule, vocabulary), OUT)
