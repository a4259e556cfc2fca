"""Registered queries of the training-data operators, with their SQL where SQL can state the result."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.llm.centroids import cluster_report
from barloom.llm.exact_dedup import exact_dedup
from barloom.llm.html_text import page_text
from barloom.llm.line_dedup import line_dedup
from barloom.llm.mixing import mix_report
from barloom.llm.packing import packed
from barloom.llm.quality import quality_report
from barloom.llm.runs import run_report
from barloom.llm.secrets import secret_report
from barloom.llm.simhash import near_report
from barloom.llm.token_counts import section_tokens
from barloom.llm.top_vectors import top_vectors
from barloom.llm.url_filter import url_verdicts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op1_line_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document what line dedup leaves: doc_id, text, n_dropped."""
    docs = table(spark, sf_dir, "documents")
    return line_dedup(docs, count="n_dropped").select("doc_id", "text", "n_dropped")


@query("op2_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


@query("op3_html_extraction")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text(table(spark, sf_dir, "pages"))


@query("op4_simhash")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_report(table(spark, sf_dir, "documents"))


@query("op5_url_filter")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages")).drop("score")


@query("op6_mixing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


@query("op7_token_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document; a token over a line's end goes to the line with most of it."""
    return section_tokens(table(spark, sf_dir, "documents"))


@query("op8_quality_rules", """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), f AS (
  SELECT doc_id, t, w, len(w) AS n_words, length(regexp_replace(t, '[ \\x09-\\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    length(t) - length(regexp_replace(t, '\\p{Lu}', '', 'g')) AS upper_chars, length(t) - length(regexp_replace(t, '\\p{L}', '', 'g')) AS letters,
    len(string_split(t, chr(10))) AS n_lines,
    list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '[ \\x09-\\x0D]', '', 'g') <> '') AS lines,
    list_transform(range(greatest(len(w) - 7, 0)), lambda i: array_to_string(w[i + 1:i + 8], ' ')) AS g,
    len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS stutters
  FROM d
), p AS (
  SELECT doc_id, unnest(g) AS g, unnest(range(len(g))) AS i FROM f
), q AS (
  SELECT doc_id, i FROM p QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), r AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM q, range(8) AS s(k) GROUP BY doc_id
), c AS (
  SELECT f.*, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n_repeat_words, 0) AS n_repeat_words FROM f LEFT JOIN r USING (doc_id)
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 20 * n_words OR 100 * n_dup_lines > 50 * n_lines
    OR word_chars / greatest(n_words, 1) NOT BETWEEN 2 AND 20 OR 100 * upper_chars > 60 * greatest(letters, 1) OR 100 * stutters > 30 * n_words) AS kept
FROM b
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents")).drop("rejected_by")


@query("op9_secret_scans")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


@query("op10_exact_dedup", """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


@query("op11_centroid_clusters")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_report(table(spark, sf_dir, "embeddings"))


@query("op12_top_vectors")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_vectors(table(spark, sf_dir, "embeddings"), every=50)


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_report(table(spark, sf_dir, "documents"))
