from pyspark.sql import functions as F

from quillgraph.engine import Engine, Models
from quillgraph.functions.models import KeywordExtractor
from quillgraph.operators import maintained

VOCABULARY = {"transformer": ("Transformer", "Method", "A network.", []), "attention": ("Attention", "Method", "Weights inputs.", ["Focus"]), "softmax": ("Softmax", "Concept", "Normalises.", [])}


def files(tmp_path):
    d = tmp_path / "docs"
    d.mkdir()
    (d / "a.md").write_text("# Attention\nThe transformer uses attention.\n## Detail\nAttention applies softmax to scores.\n")
    (d / "b.md").write_text("# Other\nA transformer again, with attention heads.\n")
    (d / "copy.md").write_text((d / "b.md").read_text())
    return d


def stored_sums_hold(e):
    """Relations and degrees as stored equal a rebuild."""
    for name, want in zip(("relations", "degrees"), maintained.rebuilt(e.read("relation_evidence"), e.read("mentions")), strict=True):
        assert sorted(map(tuple, e.read(name).collect())) == sorted(map(tuple, want.collect())), name


def test_life_of_a_corpus(spark, tmp_path):
    d = files(tmp_path)
    e = Engine(spark, f"file://{tmp_path}/store", Models(extractor=KeywordExtractor(VOCABULARY)))
    plan = {r.path.rsplit("/", 1)[1]: r.action for r in e.ingest([str(d)]).collect()}
    assert plan == {"a.md": "add", "b.md": "add", "copy.md": "add"}
    assert e.read("documents").count() == 2 and e.read("chunks").count() == 3
    mentions = {r.name: r.mention_count for r in e.read("entities").collect()}
    assert mentions == {"Transformer": 2, "Attention": 3, "Softmax": 1}
    weights = {(r.predicate, r.weight) for r in e.relations().collect()}
    assert weights == {("related_to", 10.0), ("related_to", 5.0)}
    stored_sums_hold(e)
    before = {r.table: r.fingerprint for r in e.snapshot().collect()}
    assert {r.action for r in e.ingest([str(d)]).collect()} == {"skip"}
    assert {r.table: r.fingerprint for r in e.snapshot().collect()} == before

    q = spark.createDataFrame([(1, "What does softmax do?")], "query_id long, question string")
    items = e.retrieve(q, "rag", 2).orderBy("ord").collect()
    assert "softmax" in items[0].text
    assert {r.kind for r in e.retrieve(q, "graph").collect()} >= {"entity", "relation"}
    report = e.build_wiki()
    assert report == {"written": 2, "dropped": 0, "failed": 0} and e.read("dirty_entities").count() == 0
    assert e.read("wiki_sections").count() >= 2 and e.retrieve(q.withColumn("question", F.lit("attention")), "wiki").count() >= 1
    a = e.ask(q, "all").first()
    assert a.answer and a.sources and e.analyze()["published"]
    assert e.entity(e.read("entities").where("name = 'Attention'").first().entity_id).first().pagerank > 0

    # a copy survives the removal of the other; then the document goes
    e.remove([str(d / "b.md")] + ["file:" + str(d / "b.md")])
    assert e.read("documents").count() == 2 and e.read("files").count() == 2
    e.remove(["file:" + str(d / "copy.md")])
    assert e.read("documents").count() == 1 and {r.name: r.mention_count for r in e.read("entities").collect()} == {"Transformer": 1, "Attention": 2, "Softmax": 1}
    (d / "a.md").write_text("# New\nOnly softmax here.\n")
    assert {r.action for r in e.ingest([str(d / "a.md")]).collect()} == {"change"}
    stored_sums_hold(e)
    assert {r.name for r in e.read("entities").collect()} == {"Softmax"}
    assert {r.label: r.n for r in e.status().collect()}["documents"] == 1


def test_chat_and_command_line(spark, tmp_path, capsys):
    from quillgraph.__main__ import main
    from quillgraph.chat import Chat

    d = files(tmp_path)
    root = f"file://{tmp_path}/store"
    main([root, "ingest", str(d)])
    assert "a.md" in capsys.readouterr().out
    chat = Chat(Engine(spark, root))
    chat.create("c1", "u1")
    out = chat.send("u1", "c1", "What does softmax do?")
    assert out["status"] == "done" and out["sources"]
    assert [m.role for m in chat.messages("u1", "c1").collect()] == ["user", "assistant"]
    assert chat.conversations("u1").first().title == "What does softmax do?" and chat.conversations("u2").count() == 0
    last = chat.history("u1", "c1").collect()[-1]
    assert all(s.available for s in last.sources)
    groups = {r.group for r in chat.quick_search("u1", "softmax").collect()}
    assert groups == {"conversation"}
    chat.delete("u1", "c1")
    assert chat.conversations("u1").count() == 0


def own_models():
    """Local classes, which travel to the workers by value."""

    class SameNames:
        """A judge: the same if the first words agree, whatever the language."""

        def complete(self, prompts):
            known = {"внимание": "attention"}
            first = lambda line: known.get(w := line.split(" | ")[0].split()[0].lower(), w)
            return ["same" if len({first(x) for x in p.splitlines()[1:]}) == 1 else "different" for p in prompts]


    class Writer:
        def complete(self, prompts):
            cite = lambda p: p.split("[", 1)[1].split("]", 1)[0]
            return [f"# Title\nA summary.[^{cite(p)}] [^none] See [[Transformer|the net]] and [[Unknown]].\n## Sources\nmine" for p in prompts]

    return SameNames(), Writer()


def test_resolution_and_wiki_text(spark, tmp_path):
    d = tmp_path / "docs"
    d.mkdir()
    (d / "en.md").write_text("# One\nAttention drives the transformer.\n## Two\nMore attention, and a transformer.\n")
    (d / "ru.md").write_text("# Раз\nМеханизм внимания: внимание.\n")
    vocabulary = {"attention": ("Attention", "Method", "Weights.", ["Внимание"]), "transformer": ("Transformer", "Method", "Net.", []), "внимание": ("Внимание", "Concept", "О весах.", [])}
    e = Engine(spark, f"file://{tmp_path}/store", Models(extractor=KeywordExtractor(vocabulary), writer=own_models()[1], judge=own_models()[0]))
    e.ingest([str(d)])
    names = {r.name: r for r in e.read("entities").collect()}
    assert len(names) == 2 and names.keys() <= {"Attention", "Внимание", "Transformer"}
    one = next(r for n, r in names.items() if n != "Transformer")
    assert one.mention_count == 3 and {"Attention", "Внимание"} == {one.name, *one.aliases}
    stages = {(r.stage, r.status) for r in e.read("stages").collect()}
    assert stages == {(x, "done") for x in ("parse", "chunk", "embed", "extract", "graph")} and e.failed_paths().count() == 0
    assert e.build_wiki() == {"written": 2, "dropped": 0, "failed": 0}
    pages = {r.title: r for r in e.read("wiki_pages").collect()}
    content = pages[one.name].content
    assert "[[transformer|the net]]" in content and "Unknown" in content and "[[Unknown" not in content and "[^none]" not in content and "mine" not in content
    cites = e.read("wiki_cites").collect()
    assert len(cites) == 2 and all(f"[^{c.chunk_id}]:" in {p.page_id: p for p in pages.values()}[c.page_id].content for c in cites)
    assert {(r.page_id, r.target_id) for r in e.read("wiki_links").collect()} == {(one.entity_id, names["Transformer"].entity_id), (names["Transformer"].entity_id, one.entity_id)}


def test_store_rewrites_touched_buckets(spark, tmp_path, monkeypatch):
    from quillgraph import store as st

    monkeypatch.setattr(st, "ROWS_PER_BUCKET", 10)
    s = st.TableStore(spark, f"file://{tmp_path}/s")
    rows = lambda ids, name: spark.createDataFrame([(f"e{i}", name) for i in ids], "entity_id string, dense string").select("entity_id", F.array(F.lit(1.0).cast("float")).alias("dense"))
    s.commit({"entity_vectors": rows(range(100), "a")})
    before = s.manifest()["tables"]["entity_vectors"]["buckets"]
    assert len(before) == 10 and s.read("entity_vectors").count() == 100
    s.upsert("entity_vectors", rows([3, 3, 200], "b"))
    after = s.manifest()["tables"]["entity_vectors"]["buckets"]
    assert s.read("entity_vectors").count() == 101 and 1 <= sum(a != b for a, b in zip(before, after, strict=True)) <= 2
    s.merge({"entity_vectors": (rows([5], "x").select("entity_id"), rows([], "x"))})
    assert s.read("entity_vectors").count() == 100 and s.read("entity_vectors").where("entity_id = 'e5'").isEmpty()
    # a keyed read opens the buckets of its keys alone
    place, number = s.manifest()["tables"]["entity_vectors"]["buckets"], len(before)
    for asked in ([], [7], [7, 8, 9], ["none"]):
        keys = spark.createDataFrame([(f"e{i}",) for i in asked], "entity_id string")
        found = s.read_keys("entity_vectors", keys)
        want = {r.b for r in keys.select(st.bucket_of("entity_vectors", number).alias("b")).collect()}
        assert sorted(r.entity_id for r in found.collect()) == [f"e{i}" for i in asked if i != "none"]
        opened = {f.split("/s/")[1].rsplit("/", 1)[0] for f in found.inputFiles()}
        assert opened <= {place[b] for b in want} and len(opened) <= len(want)
    # old versions go, the snapshots of the last manifests stay
    last, rows_now = s.manifest(), s.read("entity_vectors").count()
    assert s.expire(keep=1) >= 1 and s.read("entity_vectors", last).count() == rows_now and s.expire(keep=1) == 0
    s.upsert("entity_vectors", rows([300], "c"))
    assert s.read("entity_vectors").count() == rows_now + 1
    twice = spark.createDataFrame([("k", "old", 1), ("k", "new", 2)], "key string, value string, seq int")
    assert st.last_of_each(twice, ["key"]).first().value == "new"
