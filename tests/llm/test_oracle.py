import os

import duckdb
import pytest

from quillgraph.llm.queries import QUERIES, SQL

DATA = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")
TABLES = ("documents", "embeddings", "pages", "labels", "benchmark")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    cur = con.execute(SQL[name])
    names = sorted(c[0] for c in cur.description)
    at = [[c[0] for c in cur.description].index(n) for n in names]
    key = lambda x: "~" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)
    want = sorted(tuple(key(r[i]) for i in at) for r in cur.fetchall())
    df = QUERIES[name](spark, DATA)
    assert sorted(df.columns) == names
    assert sorted(tuple(key(r[n]) for n in names) for r in df.collect()) == want
