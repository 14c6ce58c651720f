"""Shared steps of the graph queries: what they move and what they give on odd rows."""

import os

import pytest

from quillgraph.operators import graph
from quillgraph.plans import driver_tables as d
from quillgraph.plans.graph_queries import Q

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return plan_of(df).count("Exchange hashpartitioning")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
def test_mentions_are_not_moved_twice(spark):
    # the lines are dealt by order once; distinct mentions took another exchange
    assert exchanges(d.mentions(spark, SF)) == 1
    # relations are summed by numbers
    assert "hashpartitioning(l_suppkey" in plan_of(d.relations(spark, SF)) or "hashpartitioning(src_id#" in plan_of(d.relations(spark, SF)).replace("L", "")


def lineitem(spark, folder, orders):
    rows = [(o, i + 1, p, s, 5.0) for o, i, p, s in orders]
    df = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double")
    df = df.selectExpr("*", "1.0D l_extendedprice", "0.0D l_discount", "0.0D l_tax", "'N' l_returnflag", "'O' l_linestatus", "date'2024-01-01' l_shipdate")
    df.write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_repeated_chunk_ids_still_merge(spark, tmp_path, monkeypatch):
    """Orders without a key share a null chunk id; long orders would repeat shown places."""
    folder = lineitem(spark, tmp_path, [(None, 0, 1, 1), (None, 1, 1, 2), (7, 0, 3, 3), (7, 1, 3, None)])
    assert d.ids_repeat(spark, folder)
    got = sorted((r.chunk_id or "", r.entity_id or "") for r in d.mentions(spark, folder).collect())
    assert got == [("", "part:1"), ("", "supplier:1"), ("", "supplier:2"), ("7:00000", "part:3"), ("7:00000", "supplier:3"), ("7:00001", ""), ("7:00001", "part:3")]
    monkeypatch.setattr(d, "PLACES", 1)
    assert d.ids_repeat(spark, folder)


def test_one_order_without_key_has_no_place(spark, tmp_path):
    folder = lineitem(spark, tmp_path, [(None, 0, 1, 1), (7, 0, 3, 3), (8, 0, None, None)])
    assert not d.ids_repeat(spark, folder)
    m, c = d.placed_mentions(spark, folder), d.chunks(spark, folder)
    assert "doc_id" in m.columns
    asked = spark.createDataFrame([("part:1",), ("part:3",)], "entity_id string")
    assert [(r.entity_id, r.chunk_id, r.doc_id, r.idx, r.total) for r in graph.entity_mentions(m, c, asked, 5).where("doc_id IS NOT NULL").collect()] == [("part:3", "7:00000", "7", 0, 1)]
    assert sorted((r.chunk_id or "", r.entity_ids) for r in graph.chunk_entity_ids(c, m).collect()) == [("", []), ("7:00000", ["part:3", "supplier:3"]), ("8:00000", [])]


def test_classes_of_queries_share_community_chunks(spark):
    e = spark.createDataFrame([("a", "x", 2.0), ("b", "x", 1.0), ("c", "y", 3.0)], "entity_id string, community string, pagerank double")
    m = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "a"), ("3", "c"), ("4", "c"), ("1", "c")], "chunk_id string, entity_id string")
    c = spark.createDataFrame([(str(k), "t") for k in range(1, 5)], "chunk_id string, text string")
    seeds = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 1, "c"), (3, 2, "a"), (4, 1, "c"), (4, 2, "b")], "query_id int, pos int, entity_id string")
    found = lambda **kw: sorted((r.query_id, r.position, r.chunk_id, r.priority, r.n) for r in graph.community_chunks(e, m, c, seeds, 3, **kw).collect())
    both = [(1, "1", 1, 3), (2, "3", 1, 1), (3, "4", 1, 1)]
    one = [(1, "1", 1, 2), (2, "2", 1, 1)]
    assert found() == [(q, *x) for q, rows in ((1, one), (2, one), (3, both), (4, both)) for x in rows]
    gone = spark.createDataFrame([(2, "1"), (4, "3")], "query_id int, chunk_id string")
    left = [(1, "1", 1, 3), (2, "4", 1, 1), (3, "2", 2, 1)]
    assert found(exclude=gone) == [(q, *x) for q, rows in ((1, one), (2, [(1, "2", 1, 1)]), (3, both), (4, left)) for x in rows]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
def test_community_chunks_join_no_query_with_mentions(spark):
    from quillgraph.plans.read_queries import Q as R

    df = R["community_chunks"](spark, SF)
    assert df.count() and "class" in plan_of(df)
    assert Q["dirty_after_removal"](spark, SF).count()


def test_nearest_of_a_group_makes_no_pairs(spark):
    """Vectors of one group meet in a grid; what has no cosine still comes last."""
    from quillgraph.operators import search

    rows = [(1, [1.0, 0.0], "x"), (2, [0.0, 1.0], "x"), (3, [1.0, 1.0], "x"), (4, [0.0, 0.0], "x"), (5, None, "x"), (6, [1.0], "x"), (7, [1.0, 0.0], "y"), (8, [1.0, 0.0], None)]
    v = spark.createDataFrame(rows, "vec_id long, dense array<float>, label string")
    q = v.where("vec_id IN (1, 4, 7, 8)").withColumnRenamed("vec_id", "query_id")
    got = search.dense_within(v, q, 6, "vec_id", "label")
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == [
        (1, 1, 1, 1.0), (1, 2, 3, 0.707107), (1, 3, 2, 0.0), (1, 4, 4, None), (1, 5, 5, None), (1, 6, 6, None),
        (4, 1, 1, None), (4, 2, 2, None), (4, 3, 3, None), (4, 4, 4, None), (4, 5, 5, None), (4, 6, 6, None), (7, 1, 7, 1.0),
    ]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
def test_filtered_knn_is_a_grid(spark):
    from quillgraph.plans.text_queries import Q as T

    assert "_cell" in plan_of(T["entity_filtered_knn"](spark, SF))


def test_sparse_grid_copies_grow_like_the_input():
    from quillgraph.operators.sparse import grid

    copies = lambda n, m, shape: n * shape[1] + m * shape[0]
    small, large = (copies(n, m, grid(n, m, 48)) for n, m in ((100_000, 300_000), (1_000_000, 3_000_000)))
    assert large < 15 * small  # 31.6 times by square roots
    # blocks and shards by square roots copied more than twice as many
    assert copies(1_000_000, 3_000_000, grid(1_000_000, 3_000_000, 48)) < 0.5 * copies(1_000_000, 3_000_000, (63, 109))
    assert grid(0, 0, 48) == (1, 1) and grid(200, 5_000_000, 48) == (1, 192)


def test_community_rounds_move_numbers(spark):
    from quillgraph.operators import communities

    ids = spark.createDataFrame([(x,) for x in ("b", "a", "c", "a", None)], "entity_id string")
    for parts in (1, 3):
        assert sorted((r.node, r.entity_id or "") for r in communities.numbered(ids.repartition(parts)).collect()) == [(0, ""), (1, "a"), (2, "b"), (3, "c")]
