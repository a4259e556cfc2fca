"""Query catalogue: each entry pairs a Spark plan with the SQL that states the same result.

``out`` declares the result columns and their comparison type, e.g. ``"symbol ts close:r n:i day:d"``:
``r`` = double rounded to 6 places, ``i`` = bigint, ``d`` = date as text, ``b`` = boolean as 0/1,
``s`` = text, nothing = as is.
"""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}
# Moves exact halves off the rounding edge, where two engines may round them differently.
NUDGE = 1.7e-10


def _columns(out: str) -> list[tuple[str, str]]:
    return [tuple((c + ":").split(":")[:2]) for c in out.split()]


def shape(df: DataFrame, out: str) -> DataFrame:
    cols = []
    for name, kind in _columns(out):
        c = F.col(name)
        cols.append({
            "r": F.round(c.cast("double") + F.lit(NUDGE), 6) + F.lit(0.0), "i": c.cast("bigint"), "d": F.to_date(c).cast("string"),
            "b": c.cast("int").cast("bigint"), "s": c.cast("string"),
        }.get(kind, c).alias(name))
    return df.select(*cols)


def _sql_columns(out: str) -> str:
    form = {
        "r": f"round(CAST({{0}} AS DOUBLE) + {NUDGE}::DOUBLE, 6) + 0.0", "i": "CAST({0} AS BIGINT)", "d": "CAST(CAST({0} AS DATE) AS VARCHAR)",
        "b": "CAST(CAST({0} AS BOOLEAN) AS BIGINT)", "s": "CAST({0} AS VARCHAR)", "": "{0}",
    }
    return ", ".join(form[k].format(n) + f" AS {n}" for n, k in _columns(out))


def _with_ctes(body: str) -> str:
    used: list[str] = []

    def visit(text: str) -> None:
        for name, sql in CTES.items():
            if name not in used and re.search(rf"(?i)\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(sql)
                if name not in used:
                    used.append(name)

    visit(body)
    return ", ".join(f"{n} AS ({CTES[n].strip()})" for n in used)


def query(name: str, out: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf: shape(fn(spark, sf), out)
        if sql is not None:
            head = _with_ctes(sql)
            ORACLES[name] = (f"WITH {head} " if head else "") + f"SELECT {_sql_columns(out)} FROM ({sql.strip()}) AS result"
        return fn

    return wrap


def cte(name: str, sql: str) -> None:
    CTES[name] = sql
