"""Queries on rows that the given tables lack, against their SQL."""

import random
from collections import Counter

import duckdb
import oracle
from pyspark.sql import functions as F

from quillgraph import catalog
from quillgraph.operators import graph, search


def compare(spark, tmp_path, name, **tables):
    """The query and its SQL over ``tables``: SELECT statements of DuckDB."""
    con = duckdb.connect()
    for table in oracle.TABLES:
        select = tables.get(table, f"FROM '/root/testdata/sf0.001/{table}.parquet'")
        con.execute(f"COPY ({select}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
    return oracle.compare(spark, str(tmp_path), name, catalog.QUERIES[name], catalog.SQL[name])


def test_entity_upserts_of_key_zero(spark, tmp_path):
    part = "SELECT * REPLACE (CASE WHEN p_partkey = 0 THEN 2 ELSE p_size END AS p_size) FROM '/root/testdata/sf0.001/part.parquet'"
    assert compare(spark, tmp_path, "entity_upserts", part=part) is None


def most_rows(spark, df):
    """Most rows that a step of the plan gave."""
    df.collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark._jsparkSession.sharedState().statusStore()
    last = store.executionsList().last().executionId()
    values, nodes, most = store.executionMetrics(last), store.planGraph(last).allNodes(), 0
    for i in range(nodes.size()):
        metrics = nodes.apply(i).metrics()
        for j in range(metrics.size()):
            m = metrics.apply(j)
            if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                most = max(most, int(values.apply(m.accumulatorId()).split("\n")[-1].split(" ")[0].replace(",", "")))
    return most


def test_names_that_many_share_are_not_paired(spark):
    rows = spark.range(2000).select(F.concat(F.lit("e"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("entity_id"), F.col("id").alias("query_id"), F.array(F.lit("same")).alias("name_keys"))
    out = search.by_name(rows, rows, 5)
    assert most_rows(spark, out) <= 20_000  # 4,000,000 pairs
    assert {r.entity_id for r in out.collect()} == {f"e000{i}" for i in range(5)} and out.count() == 10_000


def test_fulltext_matches_names_and_not_pairs(spark):
    rows = spark.range(1500).select(F.concat(F.lit("e"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("entity_id"), F.concat(F.lit("red "), F.when(F.col("id") % 2 == 0, "bolt").otherwise("ring")).alias("name"), F.lit("").alias("aliases_text"))
    asked = spark.range(1500).select(F.col("id").alias("query_id"), F.lit("Ring red").alias("query"))
    out = graph.fulltext(rows, asked, k=3)
    assert most_rows(spark, out) <= 20_000  # 3,000,000 meetings of terms
    got = {(r.query_id, r.position): (r.entity_id, r.matched) for r in out.collect()}
    assert got == {(q, n + 1): (f"e000{2 * n + 1}", 2) for q in range(1500) for n in range(3)}


def test_fulltext_unites_the_texts_of_a_query(spark):
    rows = spark.createDataFrame([("a", "red bolt", ""), ("b", "red ring", ""), ("c", "old", "ring")], "entity_id string, name string, aliases_text string")
    asked = spark.createDataFrame([(1, "red"), (1, "ring ring"), (2, "bolt"), (3, "none")], "query_id long, query string")
    got = {(r.query_id, r.entity_id): r.matched for r in graph.fulltext(rows, asked).collect()}
    assert got == {(1, "a"): 1, (1, "b"): 2, (1, "c"): 1, (2, "a"): 1}


def test_resolve_candidates_by_tiles(spark, tmp_path):
    """Copies and negatives of vectors."""
    one = "FROM '/root/testdata/sf0.001/embeddings.parquet'"
    odd = "SELECT * REPLACE (vec_id + 1000 * k AS vec_id, CASE k WHEN 1 THEN list_transform(embedding, lambda x: -x) ELSE embedding END AS embedding) " + one + ", range(3) r(k)"
    assert compare(spark, tmp_path, "resolve_candidates", embeddings=odd) is None
    df = catalog.QUERIES["resolve_candidates"](spark, str(tmp_path))
    n = spark.read.parquet(f"{tmp_path}/embeddings.parquet").count()
    assert most_rows(spark, df) < n * n / 2  # a row a pair


def test_neighborhoods_by_enumeration(spark):
    """Random graphs with triangles, loops, parallel relations and a hub; few weights tie."""
    rnd, names = random.Random(5), [f"n{i}" for i in range(14)]
    edges = {(rnd.choice(names), rnd.choice("pq"), rnd.choice(names)): float(rnd.randint(1, 4)) for _ in range(26)} | {("n0", "p", f"h{i}"): 1.0 for i in range(40)} | {("h1", "q", "h2"): 3.0, ("h3", "q", "h3"): 4.0}
    rel = spark.createDataFrame([(a, p, b, w) for (a, p, b), w in edges.items()], "src_id string, predicate string, dst_id string, weight double")
    seeds = [*names[:6], "h5", "alone"]
    ends = rel.select(F.explode(F.array("src_id", "dst_id")).alias("entity_id"))
    degree = Counter(x for a, _, b in edges for x in (a, b))
    for hops in (1, 2, 3):
        induced, around = {}, {}
        for s in seeds:
            near, before = {s}, set()
            for _ in range(hops):
                before, near = near, near | {b for a, _, b in edges if a in near} | {a for a, _, b in edges if b in near}
            row = lambda e: (*e, edges[e])
            induced[s] = [row(e) for e in sorted((e for e in edges if e[0] in near and e[2] in near), key=lambda e: (-edges[e], *e))[:7]]
            around[s] = [row(e) for e in sorted((e for e in edges if e[0] in before or e[2] in before), key=lambda e: (-edges[e], -degree[e[0]] - degree[e[2]], *e))[:7]]
        asked = spark.createDataFrame([(s,) for s in seeds], "seed_id string")
        for want, df in ((induced, graph.neighborhood_induced(rel, asked, hops, 7)), (around, graph.neighborhood(rel, ends, asked, hops, 7))):
            got = {s: [] for s in seeds}
            for r in sorted(df.collect(), key=lambda r: r.position):
                got[r.seed_id].append((r.src_id, r.predicate, r.dst_id, r.weight))
            assert got == want


def test_hubs_cost_a_seed_few_relations(spark):
    """A hundred seeds on one hub of 2,000 others."""
    hub = spark.range(2000).select(F.concat(F.lit("a"), "id").alias("src_id"), F.lit("p").alias("predicate"), F.lit("hub").alias("dst_id"), F.lit(1.0).alias("weight"))
    asked = hub.select(F.col("src_id").alias("seed_id")).limit(100)
    for df in (graph.neighborhood_induced(hub, asked, 2, 30), graph.neighborhood(hub, graph.degrees(hub), asked, 2, 30)):
        assert most_rows(spark, df) <= 20_000  # 200,000
        assert df.count() == 3000


def test_paths_through_a_hub_meet_few_relations(spark):
    hub = spark.range(2000).select(F.concat(F.lit("a"), "id").alias("src_id"), F.lit("p").alias("predicate"), F.lit("hub").alias("dst_id"), F.lit(1.0).alias("weight"))
    pairs = spark.range(100).select(F.concat(F.lit("a"), "id").alias("source"), F.concat(F.lit("a"), F.col("id") + 1).alias("target"))
    df = graph.shortest_paths(hub, pairs, max_hops=2, limit=3)
    assert most_rows(spark, df) <= 20_000  # 200,000
    assert {(r.source, r.target, *r.ids, r.weight) for r in df.collect()} == {(f"a{i}", f"a{i + 1}", f"a{i}", "hub", f"a{i + 1}", 2.0) for i in range(100)}
