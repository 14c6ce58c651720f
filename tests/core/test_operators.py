import json
import random

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import models
from quillgraph.operators import build, chunking, evaluate, retrieve, search, tables, wiki
from quillgraph.store import Conflict, TableStore


def test_store(spark, tmp_path):
    s = TableStore(spark, f"file://{tmp_path}/store")
    assert s.read("files").count() == 0 and s.revision == 0
    rows = lambda *r: spark.createDataFrame(r, "key string, value string")
    s.upsert("meta", rows(("a", "1"), ("b", "2")))
    held = s.manifest()
    s.upsert("meta", rows(("b", "3"), ("c", "4")))
    got = lambda m=None: {r.key: r.value for r in s.read("meta", m).collect()}
    assert got() == {"a": "1", "b": "3", "c": "4"} and got(held) == {"a": "1", "b": "2"} and s.revision == 2
    s.insert_absent("meta", rows(("a", "9"), ("d", "5")))
    s.delete("meta", rows(("c", "")).select("key"))
    assert got() == {"a": "1", "b": "3", "d": "5"}
    with pytest.raises(Conflict):
        s.commit({"meta": rows(("z", "z"))}, expected=1)
    assert not s.publish_analysis(1, s.read("entities"), "run") and s.publish_analysis(s.revision, s.read("entities"), "run")
    assert s.manifest()["run_id"] == "run"
    s.upsert("meta", rows(("e", "6")))
    assert s.manifest()["run_id"] is None
    s.wipe()
    assert got() == {}


def test_chunking(spark):
    doc = "intro one\nintro two\n# A\nfirst a\n## B\nin b\n\n" + "word " * 30 + "\nlast b\f# C\npage two"
    df = spark.createDataFrame([("d", "/x.md", doc), ("e", "/y.md", "\n \n")], "doc_id string, path string, text string")
    out = chunking.chunk_documents(df, max_tokens=32).orderBy("idx").collect()
    assert [(c.chunk_id, c.headings, c.page_start) for c in out] == [("d:00000", [], 1), ("d:00001", ["A"], 1), ("d:00002", ["A", "B"], 1), ("d:00003", ["A", "B"], 1), ("d:00004", ["C"], 2)]
    assert out[0].text == "intro one\nintro two" and out[2].context_text.startswith("A\nB\nin b") and out[-1].text == "page two"


def test_search_and_fusion(spark):
    c = spark.createDataFrame([("c1", "red fox jumps"), ("c2", "red dog"), ("c3", "blue cat sleeps all day"), ("c4", "")], "chunk_id string, text string")
    q = spark.createDataFrame([(1, 0, "Red fox"), (2, 0, "cat"), (3, 0, "zzz")], "query_id long, formulation int, text string")
    hits = [(r.query_id, r.chunk_id, r["rank"]) for r in search.bm25(search.postings(c), q, 5).orderBy("query_id", "rank").collect()]
    assert hits == [(1, "c1", 1), (1, "c2", 2), (2, "c3", 1)]
    embed = models.embed_column(models.HashEmbedder())
    v, asked = c.where("text <> ''").select("chunk_id", embed("text").alias("dense")), q.withColumn("dense", embed("text"))
    top = search.dense(v, asked, 1).where("query_id = 1").first()
    assert top.chunk_id == "c1" and search.dense(v, asked, 1, tile=1).count() == 3
    both = search.hybrid(search.postings(c), v, asked, 2).where("query_id = 1").orderBy("rank").collect()
    assert both[0].chunk_id == "c1" and both[0].score == pytest.approx(1.0)
    r = retrieve.rerank(search.bm25(search.postings(c), q, 5), q, c, models.OverlapReranker(), 1)
    assert {(x.query_id, x.chunk_id) for x in r.collect()} == {(1, "c1"), (2, "c3")}


def test_windows(spark):
    heads = ["Intro", "Method", "Method", "Method", "Method", "Results"]
    chunks = spark.createDataFrame([(f"d:{i:05d}", "d", i, [h], f"t{i}", [1, 2, 2, 3, 3, 4][i], "/d.pdf") for i, h in enumerate(heads)], "chunk_id string, doc_id string, idx int, headings array<string>, text string, page_start int, path string")
    hits = spark.createDataFrame([(1, "d:00002", 0.9, 1), (1, "d:00001", 0.8, 2), (1, "d:00004", 0.7, 3)], "query_id long, chunk_id string, score double, rank int")
    out = retrieve.chunk_windows(hits, chunks, 1).orderBy("ord").collect()
    assert [(r.ref, r.text, r.page) for r in out] == [("d:00002", "Method\nt1\nt2\nt3", 2), ("d:00004", "Method\nt4", 3)]


def item(q, o, ref, n, kind="chunk"):
    return (q, o, kind, ref, "x" * (4 * n), None, None, float("nan"))


def test_budgets(spark):
    a = spark.createDataFrame([item(1, 0, "a", 3), item(1, 1, "big", 90), item(1, 2, "b", 4)], retrieve.ITEM)
    b = spark.createDataFrame([item(1, 0, "a", 3), item(1, 1, "c", 30)], retrieve.ITEM)
    got = [r.ref for r in retrieve.combined({"rag": a, "wiki": b}, 100, {"rag": 0.08, "wiki": 0.3}).orderBy("ord").collect()]
    assert got == ["a", "b", "c"]
    blocks = retrieve.context_blocks(a, 5).orderBy("number").collect()
    assert [(r.number, r.ref, r.score) for r in blocks] == [(1, "a", None)]
    first = retrieve.context_blocks(a.where("ref = 'big'"), 5).collect()
    assert len(first) == 1
    marked = retrieve.mark_cited(retrieve.context_blocks(a, 500), spark.createDataFrame([(1, "so [2].")], "query_id long, answer string"))
    assert {r.ref: r.cited for r in marked.collect()} == {"a": False, "big": True, "b": False}


def test_extraction_to_graph(spark):
    reply = {
        "entities": [{"name": "Transformer", "type": "method", "description": "", "aliases": ["T"]}, {"name": "transformer ", "type": "Person", "description": "net", "aliases": ["Xf"]}, {"name": "Bert", "type": "Robot", "description": "b", "aliases": []}],
        "relations": [{"source": "T", "target": "bert", "predicate": "Used By", "description": "x", "strength": 40}, {"source": "T", "target": "Bert", "predicate": "used_by", "description": "y", "strength": 2}, {"source": "Bert", "target": "Nobody", "predicate": "p", "description": "", "strength": 1}, {"source": "Bert", "target": "BERT", "predicate": "p", "description": "", "strength": 1}],
    }
    rows = spark.createDataFrame([("d:00000", json.dumps(reply))], "chunk_id string, j string").select("chunk_id", F.from_json("j", build.EXTRACTION).alias("result"))
    e = build.clean_entities(rows)
    got = {r.norm: (r.type, r.description, r.aliases) for r in e.collect()}
    assert got == {"transformer": ("Method", "net", ["T", "Xf"]), "bert": ("Other", "b", [])}
    r = build.clean_relations(rows, e).collect()
    assert [(x.src, x.predicate, x.dst, x.strength, x.description) for x in r] == [("transformer", "used_by", "bert", 10, "x")]
    new = build.new_entities(e)
    assert new.count() == 2
    old = spark.createDataFrame([("i", "Bert", "Other", ["B"], ["one"])], "entity_id string, name string, type string, aliases array<string>, descriptions array<string>")
    m = build.merge_entities(old, spark.createDataFrame([("i", "BERT-base", ["B", "Q"], "two")], "entity_id string, name string, aliases array<string>, description string")).first()
    assert m.changed and m.aliases == ["B", "BERT-base", "Q"] and m.description == "one two"
    found = build.candidates(spark.createDataFrame([("n", "a", 1)], "new_id string, candidate_id string, pos int"), spark.createDataFrame([("n", "a", 0.99), ("n", "b", 0.8), ("n", "c", 0.5)], "new_id string, candidate_id string, score double"))
    assert [(x.candidate_id, x.pos) for x in found.orderBy("pos").collect()] == [("a", 1), ("b", 4)]
    assert build.match(found, spark.createDataFrame([("n", "b", True)], "new_id string, candidate_id string, same boolean")).first().entity_id == "b"


def test_wiki(spark):
    c = spark.createDataFrame([("1", "Soft Max", "Method", 0), ("2", "soft max", "Concept", 1), ("333333333", "Soft-Max", "Concept", 2), ("4", "New", "X", 3)], "entity_id string, name string, type string, ord int")
    t = spark.createDataFrame([("4", "kept")], "entity_id string, slug string")
    assert {r.entity_id: r.slug for r in wiki.assign_slugs(c, t).collect()} == {"1": "soft-max", "2": "soft-max-concept", "333333333": "soft-max-333333", "4": "kept"}
    body = "# T\nSum [^d:00001] see [[a|b]].\n\n## Details\nMore [^d:00002][^d:00001]\n\n## Sources\n[^x]: y"
    s = wiki.split_sections(spark.createDataFrame([("p", "T", body)], "page_id string, title string, body string")).orderBy("key").collect()
    assert [(r.key, r.section, r.text, r.chunk_ids) for r in s] == [("p#0", "Summary", "T\nSum see b.", ["d:00001"]), ("p#1", "Details", "T\nMore", ["d:00002", "d:00001"])]
    page = spark.createDataFrame([("1", 'A "q"', "Person", ["x"], "Body", ["- l"], ["[^c]: c"], 2)], "entity_id string, name string, type string, aliases array<string>, body string, lines array<string>, sources array<string>, version int").withColumn("updated", F.to_timestamp(F.lit("2024-01-02")))
    r = wiki.render_page(page).first()
    assert 'title: "A \\"q\\""' in r.content and "## Related\n\n- l" in r.content and r.content.rstrip().endswith("[^c]: c") and len(r.content_hash) == 40
    e = spark.createDataFrame([("a", 3), ("b", 1), ("c", 5)], "entity_id string, mention_count int")
    p = spark.createDataFrame([("b",), ("gone",)], "page_id string")
    got = {x.entity_id: x.action for x in wiki.eligibility(e, p, spark.createDataFrame([("a",)], "entity_id string")).collect()}
    assert got == {"a": "write", "b": "drop", "c": "keep", "gone": "drop"}


JOBS = "id long, path string, fingerprint string, kind string, status string, attempts int, available_at double, error string, hidden boolean"


def test_queue(spark):
    jobs = spark.createDataFrame([(1, "/a", "f1", "ingest", "pending", 0, 0.0, None, False), (2, "/b", "f2", "ingest", "pending", 0, 50.0, None, False), (3, "/a", "f0", "ingest", "failed", 5, 0.0, None, False)], JOBS)
    desired = spark.createDataFrame([("/a", "f1")], "path string, fingerprint string")
    state = lambda df: {r.id: (r.status, r.attempts) for r in df.collect()}
    nxt, got = tables.claim(jobs, 10.0)
    assert [r.id for r in got.collect()] == [1] and state(nxt)[1] == ("running", 1)
    assert state(tables.finish(nxt, desired, 1)) == {1: ("done", 1), 2: ("pending", 0), 3: ("superseded", 5)}
    f = {r.id: r for r in tables.fail(nxt, 1, "x", 10.0).collect()}
    assert f[1].status == "pending" and f[1].available_at == 40.0
    assert state(tables.release(nxt, 1, 0.0, 5.0))[1] == ("pending", 0) and state(tables.recover(nxt))[1] == ("pending", 1)
    assert state(tables.cancel(jobs, 2))[2] == ("cancelled", 0) and state(tables.retry(jobs))[3] == ("pending", 0)
    new = spark.createDataFrame([(9, "/a", "f9", "ingest"), (1, "/a", "f1", "ingest")], "id long, path string, fingerprint string, kind string")
    rows, want = tables.enqueue(jobs, desired, new.where("id = 9"))
    assert state(rows)[9] == ("pending", 0) and {r.path: r.fingerprint for r in want.collect()} == {"/a": "f9"}
    assert {r.status: r.n for r in tables.status_counts(jobs).collect()}["pending"] == 2
    assert [r.delay for r in spark.createDataFrame([(a,) for a in (1, 5, 9, 40)], "a int").select(tables.backoff(F.col("a")).alias("delay")).collect()] == [30, 480, 3600, 3600]


def test_usage_and_chat(spark):
    schema = "id string, seq int, model string, status string, created_at double, external boolean, tokens_in long, tokens_out long, currency string, rate_in decimal(38,18), rate_out decimal(38,18)"
    from decimal import Decimal as D

    rows = [("a", 0, "m", "started", 1.0, True, None, None, "USD", D("3"), D("15")), ("a", 1, "m", "ok", 1.0, True, 1000, 10, "USD", D("3"), D("15")), ("a", 1, "m", "ok", 1.0, True, 1000, 10, "USD", D("3"), D("15")), ("b", 1, "m", "error", 2.0, False, 5, None, "USD", D("3"), D("15"))]
    u = tables.usage_rows(spark.createDataFrame(rows, schema))
    assert {r.id: r.estimated_cost and float(r.estimated_cost) for r in u.collect()} == {"a": 0.00315, "b": None}
    assert tables.tokens_since(u, F.lit(0.0)).first().tokens == 1015
    m = spark.createDataFrame([("c", i, f"t{i}") for i in range(5)], "conversation_id string, seq int, content string")
    assert [r.content for r in tables.recent_messages(m, 2).collect()] == ["t3", "t4"]
    t = spark.createDataFrame([("1", "100% done"), ("2", "100 done")], "id string, title string")
    assert [r.id for r in tables.search_titles(t, "0% D").collect()] == ["1"]
    steps = spark.createDataFrame([("k", i, i, n, 1) for i, n in enumerate("aabba")], "key string, ts int, seq int, name string, tokens int")
    assert [(r.name, r.n) for r in tables.stage_sessions(steps).orderBy("run").collect()] == [("a", 2), ("b", 2), ("a", 1)]
    a = tables.corpus_fingerprint(m, "conversation_id", "seq", "content").first()
    assert a == tables.corpus_fingerprint(m.orderBy(F.desc("seq")), "conversation_id", "seq", "content").first()
    assert a != tables.corpus_fingerprint(m.where("seq > 0"), "conversation_id", "seq", "content").first()


def test_evaluation(spark):
    q = spark.createDataFrame([("1", "q1", None, "r"), ("2", "q2", "c", None)], "id string, question string, category string, reference string")
    a = spark.createDataFrame([("1", "rag", 1, "q", "error", "f0", 5), ("1", "rag", 2, "q", "ok", "f1", 7), ("2", "wiki", 1, "q", "ok", "f2", None)], "id string, mode string, seq int, question string, status string, answer_fingerprint string, latency_ms int").withColumn("tokens_in", F.lit(1)).withColumn("tokens_out", F.lit(2))
    p = evaluate.planned(q, a, ["rag", "wiki"])
    assert {(r.id, r.mode): r.status for r in p.collect()} == {("1", "rag"): "ok", ("1", "wiki"): "missing", ("2", "rag"): "missing", ("2", "wiki"): "ok"}
    s = spark.createDataFrame([("1", "rag", "faithfulness", 1, "ok", 0.5, "f1"), ("2", "wiki", "faithfulness", 1, "ok", 0.9, "old")], "id string, mode string, metric string, seq int, status string, value double, answer_fingerprint string")
    d = evaluate.details(p, s, ["faithfulness"])
    assert {(r.id, r.mode): r.score_status for r in d.collect()}[("2", "wiki")] == "missing"
    sm = {r.mode: r for r in evaluate.summary(d).collect()}
    assert sm["rag"].mean == 0.5 and sm["rag"].missing == 1 and sm["wiki"].latency_ms == 0
    assert evaluate.unscored(p.where("status = 'ok'"), s, ["faithfulness"]).count() == 1
    ok = evaluate.validate_questions(q).count()
    assert ok == 2
    with pytest.raises(Exception, match="bad question"):
        evaluate.validate_questions(q.union(q)).collect()


def test_poisson_bootstrap(spark):
    """The interval of a mean is about the normal one, and equal on any layout."""
    rnd = random.Random(4)
    values = [rnd.gauss(0.3, 1.0) for _ in range(400)]
    rows = [(f"q{k}", mode, pos, "m", "ok", v * pos) for k, v in enumerate(values) for pos, mode in enumerate(("a", "b"))]
    rows += [("x", "a", 0, "one", "ok", 0.5), ("x", "b", 1, "one", "ok", 0.7), ("y", "a", 0, "m", "missing", None), ("y", "b", 1, "m", "ok", 9.0)]
    df = spark.createDataFrame(rows, "id string, mode string, mode_pos int, metric string, score_status string, value double")
    out = {r.metric: r for r in evaluate.intervals(df).collect()}
    assert out["one"].pairs == 1 and out["one"].low is None and out["one"].high is None
    mean, half = sum(values) / 400, 1.96 * (sum((v - sum(values) / 400) ** 2 for v in values) / 400 / 400) ** 0.5
    assert out["m"].pairs == 400 and abs(out["m"].low - (mean - half)) < half / 5 and abs(out["m"].high - (mean + half)) < half / 5
    again = {r.metric: r for r in evaluate.intervals(df.repartition(7)).collect()}
    assert (again["m"].low, again["m"].high) == (out["m"].low, out["m"].high)
    w = spark.range(20_000).select(F.explode(evaluate.poisson_weights(F.col("id").cast("string"), F.lit(3))).alias("w")).agg(F.avg("w"), F.var_samp("w")).first()
    assert abs(w[0] - 1) < 0.02 and abs(w[1] - 1) < 0.05
