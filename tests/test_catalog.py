"""A sample of registered queries against their SQL at the smallest scale."""
import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["trade_funnel", "session_levels", "trade_context", "filter_sweep", "outcome_summary", "equity_and_drawdown", "atr_truncated", "swings", "cisd", "best_k", "permutation_test", "gap_fill", "stream_resample", "bar_text"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


def norm(row):
    return tuple(repr(round(v, 5) + 0.0) if isinstance(v, float) else str(v) for v in row)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(norm([r[c] for c in cols]) for r in df.collect())
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert got == sorted(norm(r) for r in want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
