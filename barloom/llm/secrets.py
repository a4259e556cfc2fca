"""Secret scans: fixed patterns, and windows of high entropy in candidate strings.

A candidate is a maximal run of key-like characters. A window slides over it; the counts of its characters, and from
them its Shannon entropy, are updated by the character that enters and the one that leaves. A candidate is judged
against the limit of its character class, unless the allow-list names it.
"""
from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import bind, text_of

# The base patterns (kind, pattern, group whose length counts, its least length).
BASE = (
    ("assign", r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
)
KEY = "[A-Za-z0-9+/_.=-]"
WIDTH = 20
CANDIDATE = rf"(?<!{KEY}){KEY}{{{WIDTH},}}"
# Character classes, narrowest first: name, pattern of a whole candidate, least entropy in bits of a window.
CLASSES = (
    ("entropy_hex", r"^[0-9A-Fa-f-]+$", 3.0),
    ("entropy_alnum", r"^[A-Za-z0-9]+$", 3.5),
    ("entropy_base64", r"^[A-Za-z0-9+/=_.-]+$", 3.7),
)
# Candidates of these forms are no secrets: words and phrases, numbers and dates, host names with a path, file names
# of words, rules drawn with one character. Each is a pattern that must fit, of the part before ``cut`` if one is named,
# and one that must not be found (none: any). No pattern repeats a group: engines recurse once a repetition.
ALLOW = (
    (None, r"^[A-Za-z][A-Za-z_./=+-]*$", r"[_./=+-]{2}[A-Za-z]"),
    (None, r"^[0-9+/_.=-]+$", None),
    ("/", r"^[A-Za-z0-9-][A-Za-z0-9.-]*[.][a-z]{2,}$", r"[.][.]"),
    (None, r"^/?[A-Za-z_-][A-Za-z0-9/._=-]*$", r"[0-9]{5}|[0-9][A-Za-z]"),
    (None, r"[+]{8}|/{8}|_{8}|[.]{8}|={8}|-{8}", None),
)
MARK, OTHER = "\ue000", "\ue001"  # private-use characters: no pattern matches them, so one may stand for the other
SPAN = "array<struct<start:int,end:int,rank:int,kind:string>>"


def _pieces(text: Column, pattern: str) -> Column:
    """The text cut at the matches of ``pattern``, leftmost and non-overlapping: every second piece is a match."""
    return F.split(F.regexp_replace(F.replace(text, F.lit(MARK), F.lit(OTHER)), pattern, MARK + "$0" + MARK), MARK)


def _spans(text: Column, pattern: str, accept, rank: int, kind) -> Column:
    """Accepted matches as spans in code points. ``accept``, ``kind``: of the matched string. No pattern matches MARK."""
    def walk(pieces: Column) -> Column:
        none = F.array().cast(SPAN)
        def step(a: Column, p: Column) -> Column:
            end = a["at"] + F.length(p)
            span = F.array(F.struct(a["at"].alias("start"), end.alias("end"), F.lit(rank).alias("rank"), kind(p).alias("kind")))
            found = F.when(a["odd"] & accept(p), F.concat(a["spans"], span)).otherwise(a["spans"])
            return F.struct(end.alias("at"), (~a["odd"]).alias("odd"), found.alias("spans"))
        return F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.lit(False).alias("odd"), none.alias("spans")), step)["spans"]

    return F.when(F.regexp_like(text, F.lit(pattern)), bind(_pieces(text, pattern), walk)).otherwise(F.array().cast(SPAN))


def _n_log_n(n: Column) -> Column:
    table = F.array(*[F.lit(k * log2(k) if k else 0.0) for k in range(WIDTH + 2)])
    return F.get(table, n)


def peak_entropy(s: Column) -> Column:
    """The largest Shannon entropy, in bits, of a window of WIDTH characters of ``s``; 0 for a shorter string.

    Columns cannot change an array in place: the counts, one for each character a candidate may hold, are written anew
    for every character, so a candidate costs its length times a constant of 80.
    """
    first = ord("+")
    places = F.sequence(F.lit(0), F.lit(ord("z") - first))

    def code(i: Column) -> Column:
        return F.ascii(F.substring(s, i, F.lit(1))) - first

    def step(a: Column, i: Column) -> Column:
        enters, leaves = code(i), F.when(i > WIDTH, code(i - WIDTH)).otherwise(F.lit(-1))
        n_in, n_out = F.get(a["counts"], enters), F.get(a["counts"], leaves)
        change = _n_log_n(n_in + 1) - _n_log_n(n_in) + F.coalesce(_n_log_n(n_out - 1) - _n_log_n(n_out), F.lit(0.0))
        same = enters == leaves
        counts = F.when(same, a["counts"]).otherwise(F.transform(
            a["counts"], lambda n, k: n + F.when(k == enters, 1).when(k == leaves, -1).otherwise(0)))
        total = a["total"] + F.when(same, F.lit(0.0)).otherwise(change)
        bits = F.when(i >= WIDTH, F.lit(log2(WIDTH)) - total / WIDTH).otherwise(F.lit(0.0))
        return F.struct(counts.alias("counts"), total.alias("total"), F.greatest(a["peak"], bits).alias("peak"))

    zero = F.struct(F.transform(places, lambda _: F.lit(0)).alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("peak"))
    return F.when(F.length(s) >= WIDTH, F.aggregate(F.sequence(F.lit(1), F.length(s)), zero, step)["peak"]).otherwise(F.lit(0.0))


def _class(s: Column) -> Column:
    c = F.lit(None).cast("string")
    for name, pattern, _ in reversed(CLASSES):
        c = F.when(F.regexp_like(s, F.lit(pattern)), F.lit(name)).otherwise(c)
    return c


def _is_secret(s: Column) -> Column:
    allowed = F.lit(False)
    for cut, fits, without in ALLOW:
        part = s if cut is None else F.substring_index(s, cut, 1)
        form = F.regexp_like(part, F.lit(fits))
        allowed = allowed | (form if without is None else form & ~F.regexp_like(part, F.lit(without)))
    limit = F.lit(99.0)
    for name, pattern, bits in reversed(CLASSES):
        limit = F.when(F.regexp_like(s, F.lit(pattern)), F.lit(bits)).otherwise(limit)
    return F.when(allowed, F.lit(False)).otherwise(bind(peak_entropy(s), lambda bits: bits >= limit))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and spans, an array of (start, end, rank, kind) by start and kind.

    Offsets are code points, the end exclusive. Kinds: assign, access, hex, then the entropy classes. Null text counts
    as empty; a text without findings has an empty array. Repeated rows are each reported; an empty table gives none.
    """
    t = F.col("t")
    d = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("t"))
    parts = []
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        size = (lambda p, e=pattern, g=group: F.length(F.regexp_extract(p, e, g))) if group else F.length
        parts.append(_spans(t, pattern, lambda p, s=size, n=least: s(p) >= n, rank, lambda p, k=kind: F.lit(k)))
    parts.append(_spans(t, CANDIDATE, _is_secret, len(BASE), _class))
    return d.select("doc_id", F.array_sort(F.concat(*parts)).alias("spans"))


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256 (of the base spans), spans (all, as text)."""
    found = secret_spans(docs, id_col, text_col)
    base = F.filter("spans", lambda x: x["rank"] < len(BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(kind) for kind, *_ in BASE], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def masked(docs: DataFrame, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span of the base patterns and of high entropy replaced by ``mask``; null stays null."""
    packed = docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("n"), F.col(text_col).alias("t"))
    found = secret_spans(packed, "n", "t").select(F.col("doc_id").alias("n"), "spans")
    joined = packed.join(found, "n")
    merged = F.aggregate(
        "spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.when(x["end"] <= a["at"], a).otherwise(F.struct(
            x["end"].alias("at"),
            F.concat(a["out"], F.when(x["start"] < a["at"], F.lit("")).otherwise(F.concat(F.substring(F.col("t"), a["at"] + 1, x["start"] - a["at"]), F.lit(mask)))).alias("out"))),
        lambda a: F.concat(a["out"], F.substring(F.col("t"), a["at"] + 1, F.length("t"))),
    )
    names = [F.when(F.col("t").isNull(), F.lit(None)).otherwise(merged).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    return joined.select(*names)
