"""Registered queries against their SQL."""

import duckdb
import pytest

from provenant.llm import registry


@pytest.mark.parametrize("name", [*registry.oracle_sql()])
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = registry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols and got
    assert got == sorted(tuple(str(r[names.index(c)]) for c in cols) for r in cur.fetchall())
