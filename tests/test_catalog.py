"""Every catalog query against its SQL equivalent on the smallest tables."""

import duckdb
import pytest

from tracewell.plans import catalog, readers  # noqa: F401

TABLES = ("events", "conversations", "customer", "documents", "pages")


def plain(value):
    return f"{value:.6g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, tiny, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    out = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in out.description]
    df = catalog.QUERIES[name](spark, tiny)
    assert sorted(df.columns) == sorted(names)
    want = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in out.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()) == want and want
