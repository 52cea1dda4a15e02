"""The text queries that have SQL, against it."""

import duckdb
import pytest

from tidewatch.llm.oracle import ORACLE
from tidewatch.llm.queries import QUERIES


def plain(found):
    """Rows in one order, missing cells alike whatever type pandas gives their column."""
    rows = found[sorted(found.columns)].astype(object)
    return sorted(map(str, rows.where(rows.notna(), None).map(lambda v: float(v) if isinstance(v, int) else v).values.tolist()))


@pytest.mark.parametrize("name", ORACLE)
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    expected = con.sql(ORACLE[name]).df()
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert sorted(got.columns) == sorted(expected.columns)
    assert plain(got) == plain(expected)
