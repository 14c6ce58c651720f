"""A small view graph with known answers."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import analytics, build, communities, graph, views

CHUNKS = [("A:00000", "A", 0), ("A:00001", "A", 1), ("A:00002", "A", 2), ("B:00000", "B", 0), ("B:00001", "B", 1)]
MENTIONS = [("A:00000", "ada"), ("A:00001", "ada"), ("B:00000", "ada"), ("A:00000", "babbage"), ("B:00001", "babbage"), ("A:00001", "engine"), ("A:00002", "engine"), ("A:00002", "notes"), ("B:00001", "loom"), ("B:00000", "lonely")]
FACTS = [("ada", "collaborated_with", "babbage", 3, "A:00000"), ("ada", "collaborated_with", "babbage", 3, "B:00000"), ("ada", "wrote", "notes", 5, "A:00002"), ("babbage", "designed", "engine", 8, "A:00001"), ("ada", "described", "engine", 4, "A:00001"), ("engine", "inspired_by", "loom", 2, "B:00001")]
RANKS = {"ada": (0.30, "x"), "babbage": (0.25, "x"), "engine": (0.20, "y"), "notes": (0.10, "x"), "loom": (0.10, "y"), "lonely": (0.05, "z")}
KINDS = {"ada": "Person", "babbage": "Person", "engine": "Equipment", "notes": "Work", "loom": "Equipment", "lonely": "Concept"}


@pytest.fixture(scope="module")
def g(spark):
    t = {
        "chunks": spark.createDataFrame(CHUNKS, "chunk_id string, doc_id string, idx int").withColumn("text", F.concat(F.lit("text "), "chunk_id")),
        "mentions": spark.createDataFrame(MENTIONS, "chunk_id string, entity_id string"),
        "evidence": spark.createDataFrame([(*f, "d" * i, i) for i, f in enumerate(FACTS)], "src_id string, predicate string, dst_id string, strength int, chunk_id string, description string, seq long"),
        "entities": spark.createDataFrame([(e, e.title(), KINDS[e], ["Lovelace"] if e == "ada" else [], "Lovelace" if e == "ada" else "", *RANKS[e], "run") for e in RANKS], "entity_id string, name string, type string, aliases array<string>, aliases_text string, pagerank double, community string, analytics_run_id string"),
        "pages": spark.createDataFrame([("ada", "ada", "Ada", False), ("babbage", "babbage", "Babbage", True)], "page_id string, slug string, title string, stale boolean"),
    }
    t["entities"] = build.mention_counts(t["entities"], t["mentions"])
    t["relations"] = build.relations(t["evidence"])
    return {k: v.cache() for k, v in t.items()}


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "entity_id string")


def test_merge_and_cards(spark, g):
    r = {(x.src_id, x.dst_id): x for x in g["relations"].collect()}
    assert len(r) == 5 and r["ada", "babbage"].weight == 6 and r["ada", "babbage"].evidence == ["A:00000", "B:00000"] and r["ada", "babbage"].description == "d"
    cards = {x.entity_id: x for x in graph.node_views(g["entities"], g["relations"], g["pages"], run_id="run").collect()}
    assert {k: (v.degree, v.mention_count) for k, v in cards.items()} == {"ada": (3, 3), "babbage": (2, 2), "engine": (3, 2), "notes": (1, 1), "loom": (1, 1), "lonely": (0, 1)}
    assert cards["ada"].slug == "ada" and not cards["babbage"].has_page and cards["engine"].pagerank == 0.2
    old = graph.node_views(g["entities"], g["relations"], g["pages"], ids(spark, "ada"), run_id="other").collect()
    assert [x.pagerank for x in old] == [None]


def test_adding_again_changes_nothing(g):
    again = build.add_evidence(g["evidence"], g["evidence"], g["chunks"], g["entities"])
    assert again.count() == g["evidence"].count()


def test_catalogue(spark, g):
    assert [tuple(x) for x in graph.entity_type_counts(g["entities"]).collect()][0] == ("Equipment", 2)
    names = [x.entity_id for x in graph.list_entities(g["entities"], sort="pagerank").collect()]
    assert names[:3] == ["ada", "babbage", "engine"]
    assert [x.entity_id for x in graph.list_entities(g["entities"], prefix="love").collect()] == ["ada"]
    rel = graph.entity_relations(g["relations"], g["entities"], ids(spark, "ada")).orderBy("position").collect()
    assert [(x.other_id, x.weight, x.total) for x in rel] == [("babbage", 6.0, 3), ("notes", 5.0, 3), ("engine", 4.0, 3)]
    cat = [(x.type, x.n) for x in graph.type_catalog(g["entities"], ["Person", "Software"]).collect()]
    assert cat[:2] == [("Person", 2), ("Software", 0)] and len(cat) == 5
    docs = graph.entity_documents(g["mentions"], g["chunks"], ids(spark, "ada")).orderBy("position").collect()
    assert [(x.doc_id, x.mentions, x.documents) for x in docs] == [("A", 2, 2), ("B", 1, 2)]
    pair = spark.createDataFrame([("ada", "babbage")], "a string, b string")
    c = graph.entity_comparison(g["relations"], g["mentions"], g["chunks"], pair).first()
    assert (c.shared_neighbors, c.direct_weight, c.neighbors_a, c.neighbors_b, c.shared_documents, c.shared_chunks) == (1, 6.0, 3, 2, 2, 1)


def test_subgraphs(spark, g):
    nodes, rel = graph.overview(g["entities"], g["relations"], limit=3)
    assert {x.entity_id for x in nodes.collect()} == {"ada", "babbage", "engine"} and rel.count() == 3
    seeds = spark.createDataFrame([("loom",)], "seed_id string")
    ends = g["relations"].select(F.col("src_id").alias("entity_id")).union(g["relations"].select("dst_id"))
    hop = lambda n: [(x.src_id, x.dst_id) for x in graph.neighborhood(g["relations"], ends, seeds, n, 10).orderBy("position").collect()]
    assert hop(1) == [("engine", "loom")] and len(hop(2)) == 3 and len(hop(3)) == 5
    induced = graph.neighborhood_induced(g["relations"], seeds, 2, 10).collect()
    assert len(induced) == 4  # the edge between ada and babbage is induced, too
    pairs = spark.createDataFrame([("notes", "loom"), ("ada", "engine"), ("ada", "ada"), ("ada", "lonely")], "source string, target string")
    paths = {(x.source, x.position): x for x in graph.shortest_paths(g["relations"], pairs).collect()}
    assert paths["notes", 1].ids == ["notes", "ada", "engine", "loom"] and paths["notes", 1].weight == 11 and paths["ada", 1].length == 1 and len(paths) == 2


def test_communities(spark, g):
    c = {x.community: x for x in graph.communities(g["entities"]).collect()}
    assert c["x"].size == 3 and c["x"].leaders == ["ada", "babbage", "notes"] and c["y"].types == {"Equipment": 2}
    seeds = spark.createDataFrame([(1, 1, "loom")], "query_id long, pos int, entity_id string")
    found = graph.community_chunks(g["entities"], g["mentions"], g["chunks"], seeds, 2).orderBy("position").collect()
    assert [x.chunk_id for x in found] == ["A:00001", "A:00002"]
    n = graph.analysis_counts(g["entities"], spark.createDataFrame([(1.0,), (0.0,), (float("nan"),), (float("inf"),)], "weight double")).first()
    assert (n.nodes, n.relations, n.bad_weights) == (6, 4, 3)


def test_removal(spark, g):
    b = spark.createDataFrame([("B",)], "doc_id string")
    plan = {x.entity_id: x.removed for x in build.deletion_plan(g["mentions"], g["chunks"], b).collect()}
    assert plan == {"ada": False, "babbage": False, "loom": True, "lonely": True}
    out = build.delete_documents({"chunks": g["chunks"], "mentions": g["mentions"], "entities": g["entities"], "relation_evidence": g["evidence"], "wiki_pages": g["pages"]}, b)
    assert {x.entity_id for x in out["entities"].collect()} == {"ada", "babbage", "engine", "notes"}
    left = {(x.src_id, x.dst_id): x for x in build.relations(out["relation_evidence"]).collect()}
    assert left["ada", "babbage"].weight == 3 and left["ada", "babbage"].description == "" and ("engine", "loom") not in left


def test_analytics(g):
    ranks = {x.entity_id: x.pagerank for x in analytics.pagerank(g["entities"], g["relations"]).collect()}
    assert ranks["lonely"] == pytest.approx(0.15) and ranks["engine"] > ranks["loom"] and ranks["ada"] > ranks["notes"]
    one, two = ({x.entity_id: x.community for x in communities.communities(g["entities"], g["relations"]).collect()} for _ in range(2))
    assert one == two and one["lonely"] not in {v for k, v in one.items() if k != "lonely"} and all(v.startswith("community:") for v in one.values())


def test_views(spark, g):
    nodes, rel = views.visible(g["entities"], g["relations"], types=["Person"], hide_isolated=True)
    assert {x.entity_id for x in nodes.collect()} == {"ada", "babbage"} and rel.count() == 1
    s = views.community_summaries(g["entities"]).first()
    assert (s.community, s["size"], s.names, s.label) == ("x", 3, ["Ada", "Babbage", "Notes"], "Ada, Babbage and 1 more")
    assert views.size_metric(g["entities"]).first().metric == "pagerank"
    p = [tuple(x) for x in views.predicate_counts(g["entities"], g["relations"], ["gone"], min_weight=5.0).collect()]
    assert p[-1] == ("gone", 0, 0) and ("described", 1, 0) in p
    assert views.rank_by_pagerank(g["entities"]).where("rank = 1").first().entity_id == "ada"


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no driver tables here")
def test_community_keys_cover_all_relations(spark):
    from quillgraph.plans import driver_tables as d
    from quillgraph.plans.graph_queries import community_keys

    sf = "/root/testdata/sf0.001"
    label = {r.entity_id: r.community for r in community_keys(spark, sf).collect()}
    assert set(label) == {r.entity_id for r in d.named_entities(spark, sf).collect()}
    # a community is connected by relations, supplies among them, so parts don't stay alone
    ends = {x for r in d.relations(spark, sf).collect() for x in (r.src_id, r.dst_id)}
    sizes = Counter(label.values())
    assert all(sizes[label[x]] > 1 for x in ends) and any(x.startswith("part:") for x in ends)
