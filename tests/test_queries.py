"""Every query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from folio import queries as Q
from folio import roundtrips  # noqa: F401  registers its queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(None if v != v else v for v in r) for r in df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query(spark, sql, name):
    assert rows(Q.QUERIES[name](spark, SF).toPandas()) == rows(sql.sql(Q.ORACLES[name]).df())


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(Q.QUERIES) <= set(e.queries())
