"""Quality rules as a short-circuit cascade.

Each rule says which documents to reject. Cost and rejection rate of every rule are measured on a sample; the rules
are then tried in order of rejection per cost, and a document stops at the first that rejects it. The verdict is a
conjunction, so the order changes the cost and never the result.
"""
from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import SPACE, bind, stored, text_of, words_of

SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
SAMPLE_ROWS = 2000


def n_words(words: Column) -> Column:
    return F.size(words).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACE, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, SPACE, "")) > 0)
    return bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that occur at least twice in the text.

    Windows are compared by a 64-bit hash within their own text. Only texts that repeat one pay for a sort.
    """
    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        repeated = bind(placed, lambda s: F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])))
        at = F.sort_array(F.transform(repeated, lambda x: x["i"]))
        return F.aggregate(
            at, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda a, p: F.struct((p + window).alias("end"), (a["n"] + p + window - F.greatest(p, a["end"])).alias("n")),
        )["n"].cast("long")

    hashed = bind(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)])),
    )
    some = bind(hashed, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(F.size(words) > window, some).otherwise(F.lit(0).cast("long"))


@dataclass(frozen=True)
class Rule:
    """``rejects``: text, words -> boolean column, true for documents to reject, never null."""

    name: str
    rejects: object


def share_above(part: Column, whole: Column, percent: int) -> Column:
    return part * 100 > whole * percent


def _upper(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}", ""))


def _letters(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, r"\p{L}", ""))


def _stutters(words: Column) -> Column:
    """Words that equal the word before them."""
    return bind(words, lambda w: F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))))


# The first two are the base of every verdict; limits are wide, so that ordinary prose of any language passes.
FEW_WORDS = Rule("few_words", lambda text, words: F.size(words) < 20)
REPEATS = Rule("repeats", lambda text, words: share_above(n_repeat_words(words), n_words(words), 30))
RULES = (
    FEW_WORDS,
    REPEATS,
    Rule("symbols", lambda text, words: share_above(n_symbols(text), n_words(words), 20)),
    Rule("dup_lines", lambda text, words: share_above(n_dup_lines(text), F.size(F.split(text, "\n")), 50)),
    Rule("word_length", lambda text, words: ~(word_chars(text) / F.greatest(F.size(words), F.lit(1))).between(2, 20)),
    Rule("shouting", lambda text, words: share_above(_upper(text), F.greatest(_letters(text), F.lit(1)), 60)),
    Rule("stutter", lambda text, words: share_above(_stutters(words), n_words(words), 30)),
)


def measured(docs: DataFrame, rules: tuple[Rule, ...], text_col: str = "text", sample_rows: int = SAMPLE_ROWS, seed: int = 42) -> list[tuple[Rule, float, float]]:
    """(rule, seconds on the sample, share rejected), in the order of the cascade.

    The sample holds about ``sample_rows`` rows of the whole table. Its figures order the rules and nothing else.
    """
    rows = docs.count()
    sample = stored(docs.select(text_of(text_col).alias("t")).sample(min(1.0, sample_rows / max(rows, 1)), seed).repartition(2))
    base = sample.select("t", words_of(F.col("t")).alias("w"))

    def timed(rejects: Column) -> tuple[float, float]:
        best, share = float("inf"), 0.0
        for _ in range(2):
            began = time.perf_counter()
            hit, n = base.agg(F.sum(rejects.cast("long")), F.count(F.lit(1))).first()
            best, share = min(best, time.perf_counter() - began), (hit or 0) / max(n, 1)
        return best, share

    floor = timed(F.size("w") < 0)[0]  # reading and splitting, which all rules share
    found = []
    for r in rules:
        seconds, share = timed(r.rejects(F.col("t"), F.col("w")))
        found.append((r, max(seconds - floor, 1e-4), share))
    return sorted(found, key=lambda x: (-x[2] / x[1], x[0].name))


def verdict(text: Column, words: Column, rules: list[Rule]) -> Column:
    """Name of the first rule that rejects the text, null if none does. Later rules run only where earlier ones pass."""
    c = F.lit(None).cast("string")
    for r in reversed(rules):
        c = F.when(r.rejects(text, words), F.lit(r.name)).otherwise(c)
    return c


def quality_filter(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows of ``docs`` that no rule rejects, with the columns they had.

    Null text counts as empty and is rejected by few_words. Repeated rows are judged alike; an empty table gives none.
    """
    order = [r for r, _, _ in measured(docs, rules, text_col)]
    packed = docs.select(F.struct("*").alias("row"), text_of(text_col).alias("t"))
    packed = packed.withColumn("w", words_of(F.col("t")))
    return packed.where(verdict(F.col("t"), F.col("w"), order).isNull()).select("row.*")


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: its counts, base_failed, rejected_by (first rule of the cascade) and kept.

    Null text: no words, base_failed. The report gives the counts of the two base rules for every document, so these come
    first whatever they cost, and the cascade orders the others.
    """
    later = [r for r, _, _ in measured(docs, rules, text_col) if r.name not in (FEW_WORDS.name, REPEATS.name)]
    t, w = F.col("t"), F.col("w")
    d = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("t")).withColumn("w", words_of(t))
    d = d.select(
        "doc_id", "t", "w", n_words(w).alias("n_words"), word_chars(t).alias("word_chars"), n_symbols(t).alias("n_symbols"),
        n_dup_lines(t).alias("n_dup_lines"), n_repeat_words(w).alias("n_repeat_words"),
    )
    few, repeats = F.col("n_words") < 20, share_above(F.col("n_repeat_words"), F.col("n_words"), 30)
    by = F.when(few, F.lit(FEW_WORDS.name)).when(repeats, F.lit(REPEATS.name)).otherwise(verdict(t, w, later))
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (few | repeats).alias("base_failed"), by.alias("rejected_by"),
    ).withColumn("kept", F.col("rejected_by").isNull())
