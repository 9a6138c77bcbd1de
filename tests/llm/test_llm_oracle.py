"""The queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from clauselens.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_sql(spark, key):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    res = con.execute(ORACLE[key])
    cols = [d[0] for d in res.description]
    want = sorted((dict(zip(cols, r)) for r in res.fetchall()), key=repr)
    want = sorted((sorted(r.items()) for r in want), key=repr)
    got = sorted((sorted(r.asDict().items()) for r in QUERIES[key](spark, SF).collect()), key=repr)
    assert got == want
