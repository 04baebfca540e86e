import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tidewell.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(df):
    """Sorted rows of plain values, columns by name."""
    df = df[sorted(df.columns)]
    value = lambda x: None if pd.isna(x) else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(map(repr, ([value(v) for v in row] for row in df.astype(object).itertuples(index=False))))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_spark_and_sql_agree(spark, sf_dir, con, name):
    got, want = catalog.QUERIES[name](spark, sf_dir).toPandas(), con.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_refine_marks_every_claimed_row(spark, sf_dir):
    rows = catalog.QUERIES["refine_outcomes"](spark, sf_dir).collect()
    assert len({r.id for r in rows}) == len(rows) > 0
    assert {r.outcome for r in rows} <= {"refined", "rejected", "duplicate"}
