"""Queries of the training-data operators against their SQL equivalents on the smallest tables."""

import duckdb
import pytest

from tracewell.llm import queries
from tracewell.llm.sql import ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, tiny, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    out = con.execute(ORACLES[name])
    names = sorted(c[0] for c in out.description)
    at = [[c[0] for c in out.description].index(n) for n in names]
    df = queries.queries()[name](spark, tiny)
    assert sorted(df.columns) == names
    want = sorted((tuple(r[i] for i in at) for r in out.fetchall()), key=str)
    assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=str) == want and want
