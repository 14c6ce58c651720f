from quillgraph.operators import analytics, build


def test_pagerank_moves_numbers(spark, monkeypatch):
    """names are read at the start and at the end only; an end that is no entity
    takes its share and gives none."""
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "entity_id string")
    rel = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 2.0), ("b", "c", 1.0), ("c", "gone", 4.0), ("a", "a", 9.0)], "src_id string, dst_id string, weight double")
    kept, cut = [], analytics.cut
    monkeypatch.setattr(analytics, "cut", lambda df: kept.append(dict(df.dtypes)) or cut(df))
    got = {x.entity_id: x.pagerank for x in analytics.pagerank(nodes, rel, iterations=5).collect()}
    assert all("string" not in t.values() for t in kept[1:-1]) and len(kept) >= 4
    w = {("a", "b"): 3.0, ("b", "a"): 3.0, ("b", "c"): 1.0, ("c", "b"): 1.0, ("c", "gone"): 4.0}
    total = {x: sum(v for (a, _), v in w.items() if a == x) for x in "abc"}
    rank = dict.fromkeys("abcd", 0.15)
    for _ in range(5):
        rank = {x: 0.15 + 0.85 * sum(v / total[a] * rank[a] for (a, b), v in w.items() if b == x) for x in rank}
    assert all(abs(rank[x] - got[x]) < 1e-12 for x in rank) and len(got) == 4


def test_relations_are_cleaned_with_entities_taken_once_an_end(spark):
    """normal names and aliases of entities come from one pass."""
    schema = "chunk_id string, result struct<entities: array<struct<name: string, type: string, description: string, aliases: array<string>>>, relations: array<struct<source: string, target: string, predicate: string, description: string, strength: int>>>"
    rows = spark.createDataFrame([("c", ([("Ada L", "person", "", ["Countess", None, "Engine"]), ("Engine", "product", "", [])], [("countess", "ENGINE", "Wrote on", "", 3), ("gone", "Engine", "x", "", 1)]))], schema)
    out = build.clean_relations(rows, build.clean_entities(rows))
    assert [(x.src, x.predicate, x.dst, x.strength) for x in out.collect()] == [("ada l", "wrote_on", "engine", 3)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("posexplode(") == 3
