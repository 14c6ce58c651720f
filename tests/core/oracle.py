"""Runs catalogue queries in Spark and their SQL in DuckDB and compares."""

import os
import sys

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if x is None:
        return "~"
    if hasattr(x, "isoformat"):
        return x.isoformat(sep=" ") if hasattr(x, "hour") else x.isoformat()
    if isinstance(x, bool):
        return str(x)
    try:
        return f"{round(float(x), 5) + 0.0:.5f}" if not isinstance(x, str) else x
    except (TypeError, ValueError):
        return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, sf_dir, name, query, sql):
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got[1] or True else "no rows"
    cur = duck(sf_dir).execute(sql)
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        odd = [x for x in zip(got[1], want[1]) if x[0] != x[1]][:2]
        return f"{len(got[1])} rows, want {len(want[1])}; first differences {odd}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    import time
    import traceback

    from quillgraph import catalog
    from quillgraph.session import session

    spark = session("oracle", os.environ.get("ORACLE_MASTER", "local[3]"), **{"spark.sql.shuffle.partitions": "6", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    spark.sparkContext.setLogLevel("ERROR")
    for name in sys.argv[2:] or catalog.QUERIES:
        t = time.time()
        try:
            out = compare(spark, sys.argv[1], name, catalog.QUERIES[name], catalog.SQL.get(name))
        except Exception:
            out = "ERROR " + traceback.format_exc()[-700:]
        print(f"{'ok  ' if out is None else 'BAD '} {name} {time.time() - t:.1f}s {'' if out is None else out}", flush=True)
