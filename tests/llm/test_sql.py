"""Queries of the subpackage against their SQL."""

import duckdb
import pytest

from vellum.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, wide, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{wide}/documents.parquet')")
    found = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    shown = lambda rows: sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in rows)
    got = queries.QUERIES[name](spark, wide).select(*columns).collect()
    assert shown(got) == shown(found.fetchall())
