"""URL filter: rules first, then gradient-boosted trees on lexical features.

The trees learn from labelled URLs. The features are computed in columns: length, depth, digit ratio, entropy,
parameters, hyphens, and statistics of host suffixes as log odds among the labelled URLs. No list of words is used.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from math import log
from random import Random

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import bind, lower_ascii

# The policy of the registered query (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
# Endings of the labelled hosts, and how many in ten of their urls are to block.
ENDINGS = {"com": 5, "org": 3, "net": 5, "info": 7, "biz": 8, "xyz": 9, "top": 9, "click": 9, "edu": 1, "gov": 1, "io": 4, "de": 3, "fr": 3, "co.uk": 2}
CONSONANTS, VOWELS = "bcdfglmnprstv", "aeiou"
FEATURES = ["length", "host_length", "depth", "digit_ratio", "entropy", "parameters", "hyphens", "labels", "suffix_odds"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, from the first :// up to /, ? or #; path from there up to ? or #. Both empty without ://."""
    form = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(u, form, 1)), F.regexp_extract(u, form, 2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is the url's or a parent of it and whose path begins the url's."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def labelled_urls(n: int = 1600, seed: int = 42, consonants: str = CONSONANTS) -> list[tuple[str, int]]:
    """(url, 1 = block): ``n`` urls with invented words, half of them to block.

    No word tells them apart, only form: unwanted hosts tend to be long, hyphenated and full of digits, under other
    endings, with deeper paths, random tokens and more parameters. Every form occurs under both labels.
    """
    rng = Random(seed)

    def word(syllables: int) -> str:
        return "".join(rng.choice(consonants) + rng.choice(VOWELS) + (rng.choice(consonants) if rng.random() < 0.4 else "") for _ in range(syllables))

    def token(size: int) -> str:
        return "".join(rng.choice(consonants + VOWELS + "0123456789" * 2) for _ in range(size))

    out = []
    for k in range(n):
        block = k % 2
        odd = rng.random() < (0.85 if block else 0.1)  # the form that is usual for the label, or that of the other
        ending = rng.choices(list(ENDINGS), [v if block else 10 - v for v in ENDINGS.values()])[0]
        words = [word(rng.randint(1, 3)) for _ in range(rng.choice((2, 2, 3, 4)) if odd else rng.choice((1, 1, 1, 2)))]
        if odd and rng.random() < 0.35:
            words[-1] += str(rng.randint(1, 9999))
        name = ("-" if rng.random() < (0.75 if odd else 0.15) else "").join(words)
        below = rng.choice(("", "", "www.", f"{token(rng.randint(4, 12))}.", f"{word(1)}.{word(1)}.") if odd else ("", "www.", "www.", "m.", "blog."))
        # Hosts of one's own stand right under the ending, others under the name of a provider.
        host = f"{below}{name}.{word(2) + '.' if rng.random() < 0.3 else ''}{ending}"
        if odd and rng.random() < 0.6:
            path = "/" + "/".join(rng.choice((token(rng.randint(3, 16)), word(2), str(rng.randint(1, 10 ** 6)))) for _ in range(rng.randint(1, 7)))
        else:
            path = rng.choice(("/", "/{l}/{n}", "/{l}/{n}/", "/{l}/{n}.html", "/{w}", "/{w}/{w}-{w}", "/{y}/{m:02}/{w}-{w}-{w}", "/{l}/{w}/{n}")).format(
                l=rng.choice(("en", "de", "fr", "es")), n=rng.randint(1, 99999), w=word(2), y=rng.randint(2001, 2024), m=rng.randint(1, 12))
        count = rng.choice((0, 0, 0, 1, 2, 3, 4, 5)) if odd else rng.choice((0, 0, 0, 1, 2))
        query = "&".join(f"{word(1)}={token(rng.randint(1, 20)) if odd else rng.choice((word(2), rng.randint(1, 99)))}" for _ in range(count))
        out.append((f"http{'s' * (rng.random() < 0.65)}://{host}{path}{'?' * bool(query)}{query}{'#top' * (rng.random() < 0.05)}", block))
    return out


def _suffixes(host: str) -> set[str]:
    parts = host.split(".")
    return {".".join(parts[-k:]) for k in range(1, min(3, len(parts)) + 1)}


def _host(url: str) -> str:
    return url.partition("://")[2].split("/")[0].split("?")[0].split("#")[0].lower()


def _counted(labelled: Sequence[tuple[str, int]], least: int = 5) -> dict[str, tuple[int, int]]:
    """For every suffix of at least ``least`` of the labelled hosts: how many have it, and how many of those are to block."""
    seen, bad = Counter(), Counter()
    for url, label in labelled:
        for k in _suffixes(_host(url)):
            seen[k] += 1
            bad[k] += label
    return {k: (n, bad[k]) for k, n in sorted(seen.items()) if n >= least}


def _odds(n: int, bad: int) -> float:
    """Smoothed log odds of block."""
    return round(log((bad + 1) / (n - bad + 1)), 4)


def _held_out(labelled: Sequence[tuple[str, int]], folds: int = 5) -> list[float]:
    """For every labelled url the odds of its suffixes among the other folds: labels of its own fold don't show in it."""
    out = [0.0] * len(labelled)
    for f in range(folds):
        counts = _counted([x for k, x in enumerate(labelled) if k % folds != f])
        for k in range(f, len(labelled), folds):
            out[k] = sum(_odds(*counts.get(key, (0, 0))) for key in _suffixes(_host(labelled[k][0])))
    return out


def _lookup(keys: Column, odds: dict[str, float]) -> Column:
    """The sum of the odds of an array of keys; unknown keys say nothing."""
    table = F.create_map(*[F.lit(x) for kv in odds.items() for x in kv]) if odds else F.expr("cast(map() as map<string,double>)")
    return F.aggregate(keys, F.lit(0.0), lambda a, k: a + F.coalesce(F.try_element_at(table, k), F.lit(0.0)))


def _entropy(s: Column) -> Column:
    def bits(chars: Column) -> Column:
        return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - bind(
            F.size(F.filter(chars, lambda x: x == c)) / F.size(chars), lambda p: p * F.log2(p)))
    return F.when(F.length(s) > 0, bind(F.split(s, ""), bits)).otherwise(F.lit(0.0))


def _count(s: Column, what: str) -> Column:
    return F.length(s) - F.length(F.regexp_replace(s, what, ""))


@dataclass(frozen=True)
class UrlModel:
    trees: GBTClassificationModel
    suffix_odds: dict[str, float]


def with_features(urls: DataFrame, suffix_odds: dict[str, float]) -> DataFrame:
    """``urls`` (url, host, path and others) with the columns of FEATURES; digits and entropy are those of host and path."""
    u, host, path = F.coalesce(F.col("url"), F.lit("")), F.col("host"), F.col("path")
    shown = F.concat(host, path)
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.array_join(F.slice(parts, -F.least(k, F.size(parts)), F.least(k, F.size(parts))), "."))
    columns = {
        "length": F.length(u), "host_length": F.length(host), "depth": _count(path, "/"),
        "digit_ratio": _count(shown, "[0-9]") / F.greatest(F.length(shown), F.lit(1)), "entropy": _entropy(shown),
        "parameters": _count(u, "[&?]"), "hyphens": _count(host, "-"), "labels": F.size(parts),
        "suffix_odds": _lookup(F.array_distinct(suffixes), suffix_odds),
    }
    return urls.withColumns({k: c.cast("double") for k, c in columns.items()})


def _assembled(d: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(d)


def train_urls(spark: SparkSession, labelled: Sequence[tuple[str, int]] | None = None, rounds: int = 20, depth: int = 3, seed: int = 42) -> UrlModel:
    """Boosted trees from labelled URLs (a bounded list; by default ``labelled_urls``)."""
    labelled = list(labelled or labelled_urls())
    rows = [(u, float(v), odds) for (u, v), odds in zip(labelled, _held_out(labelled))]
    d = spark.createDataFrame(rows, "url string, label double, others double").coalesce(1)
    host, path = host_and_path(F.col("url"))
    d = with_features(d.withColumns({"host": host, "path": path}), {}).withColumn("suffix_odds", F.col("others"))
    trees = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed).fit(_assembled(d))
    return UrlModel(trees, {k: _odds(*c) for k, c in _counted(labelled).items()})


def url_verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, model: UrlModel | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the trees' probability of block) of every row of ``pages``.

    The longest rule that fits decides, else the trees do (block above 0.5). Null urls and urls without :// have an
    empty host and path, fit no rule and are judged by the trees. Repeated rows are judged alike; other columns are
    ignored; an empty table gives no rows.
    """
    model = model or train_urls(pages.sparkSession)
    host, path = host_and_path(F.col(url_col).cast("string"))
    d = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    d = model.trees.transform(_assembled(with_features(d, model.suffix_odds)))
    d = d.withColumn("score", F.get(vector_to_array("probability"), 1))
    return d.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") > 0.5, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "score")
