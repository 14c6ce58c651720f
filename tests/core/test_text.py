import hashlib
import uuid

from pyspark.sql import functions as F

from quillgraph.operators import build
from quillgraph.functions import models, text


def one(spark, *columns, row="1"):
    return list(spark.sql(f"SELECT {row} AS x").select(*columns).first())


def test_golden_ids(spark):
    lit = F.lit
    assert one(spark, text.entity_id(lit("Method"), lit("attention mechanism")), text.entity_id(lit("Person"), lit("ashish vaswani"))) == ["42454f7230bee8f7", "5f2cfae423c91f73"]
    assert one(spark, text.point_id(lit("abc:00001")), text.point_id(lit("chunk:0123456789abcdef:00000"))) == ["3abf48ae-e1b7-5cab-8afa-229e4a8c8f55", "6205ee60-de3b-5dea-bf3e-373d09f1a7ee"]
    assert one(spark, text.point_id(lit("é")))[0] == str(uuid.uuid5(uuid.UUID(text.NAMESPACE_HEX), "é"))
    assert one(spark, text.file_doc_id(lit("a text\n"))) == [hashlib.sha256(b"a text\n").hexdigest()[:16]]
    assert one(spark, text.chunk_id(lit("ab"), lit(7))) == ["ab:00007"]


def test_names(spark):
    df = spark.createDataFrame([("Machine-Learning",), ("C++ / C#",), ("ＦＵＬＬ_width",), ("Straße",), ("",), (None,)], "n string")
    got = [r[0] for r in df.select(text.normalize_name("n")).collect()]
    assert got == ["machine learning", "c++ c#", "full width", "strasse", "", None]
    slugs = [r[0] for r in df.select(text.slugify("n")).collect()]
    assert slugs[:2] == ["machine-learning", "c++-csharp"] and slugs[4] == "untitled"
    long = spark.createDataFrame([("word " * 40,), ("ж" * 300,)], "n string").select(text.slugify("n").alias("s")).collect()
    assert all(len(r.s) <= 80 and len(r.s.encode()) <= 200 and r.s[-9] == "-" for r in long)
    assert one(spark, text.entity_name_keys(F.array(F.lit("Mag AO-X"), F.lit("magaox"), F.lit("B"))))[0] == ["b", "magaox"]
    wide = [F.lit(x) for x in ("Ｗｉｄｅ ﬁne", "STRASSE", "Straße", "wide_fine")]
    assert one(spark, text.entity_name_keys(F.array(*wide)), text.normalize_name(wide[0])) == [["strasse", "widefine"], "wide fine"]


def test_names_of_the_graph_are_folded(spark):
    """Spellings that differ in width, ligatures or case folding are one entity."""
    reply = [[("Ｓtraße", "Place", "a", ["Weg"]), ("STRASSE", "Place", "b", [])], [("Strasse", "weg", "leads_to", "x", 3)]]
    df = spark.createDataFrame([("c", reply)], f"chunk_id string, result {build.EXTRACTION}")
    e = build.clean_entities(df)
    assert [(r.norm, r.name) for r in e.collect()] == [("strasse", "Ｓtraße")]
    assert build.clean_relations(df, e).collect() == []  # both ends are one entity


SECRETS = {
    '{"password": "hunter2", "user": "bob"}': ["hunter2"],
    "access_token=abc passwd=q1w2 key=zz99": ["abc", "q1w2", "zz99"],
    "api-key: 123abc&secret=s3cr": ["123abc", "s3cr"],
    "GET https://bob:pw1@host/x Bearer to.k-en": ["bob", "pw1", "to.k-en"],
    "sk-abcdefgh12 failed": ["abcdefgh12"],
}


def test_secrets_are_masked(spark):
    df = spark.createDataFrame([(m,) for m in SECRETS], "m string")
    for r in df.select("m", text.safe_error(F.lit("Error"), F.col("m")).alias("e")).collect():
        assert r.e.startswith("Error: ") and "***" in r.e and not any(x in r.e for x in SECRETS[r.m]), r
    plain = "monkey=1 keyboard: x risk-short tokenizer=5"
    assert one(spark, text.safe_error(F.lit("E"), F.lit(plain)))[0] == f"E: {plain}"


def test_generated_sections_and_citations(spark):
    bodies = ["# T\nA\n\n\n\nB\n##  sources \nx", "A\n## Related work\nB", "A [^x] b[^y]\n[^x]: note\nC", "## RELATED", "# Only", "A\n  ## Sources"]
    want = ["A\n\nB", "A\n## Related work\nB", "A [^x] b[^y]\n\nC", "", "", "A\n  ## Sources"]
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, b string")
    assert [r.s for r in df.orderBy("i").select(text.strip_reserved_sections(F.col("b")).alias("s")).collect()] == want
    cites = spark.createDataFrame([("a [^x] b [^y], c[^x]\t[^z].", ["x"]), ("[^a][^b]", ["b", "a"]), (None, None), ("plain", None), ("k [^k]", None)], "b string, ok array<string>")
    got = [tuple(r.v) for r in cites.select(text.validate_citations(F.col("b"), F.col("ok")).alias("v")).collect()]
    assert got == [("a [^x] b, c[^x].", ["x"]), ("[^a][^b]", ["a", "b"]), ("", []), ("plain", []), ("k", [])]


def test_cleaning(spark):
    lit = F.lit
    assert one(spark, text.strip_think(lit("<think>a\nb</THINK> hi ")), text.clean_json(lit('```json\n{"a": {"b": 1}} tail\n```'))) == ["hi", '{"a": {"b": 1}}']
    masked = one(spark, text.safe_error(lit("E"), lit("Bearer abc sk-XYZ12 http://u:pw@h token=zzz " + "q" * 600)))[0]
    assert "abc" not in masked and "XYZ12" not in masked and "pw@" not in masked and "zzz" not in masked and len(masked) == 500 and masked.endswith("…")
    assert one(spark, text.cited_ids(lit("a [^x] b [^y][^x]")), text.cited_numbers(lit("see [2] and [1], [2]"))) == [["x", "y"], [2, 1]]
    assert one(spark, text.strip_reserved_sections(lit("# T\n\nBody\n\n\n\nMore\n## Related\nx\n[^a]: b"))) == ["Body\n\nMore"]
    assert one(spark, text.needs_translation(lit("Привет abc мир")), text.needs_translation(lit("hello é")), text.needs_translation(lit("123"))) == [True, False, False]
    assert one(spark, text.estimate_tokens(lit("abc")), text.estimate_tokens(lit("x" * 41))) == [1, 10]
    parts = one(spark, text.split_matches(lit("aXbxc"), ["x"]))[0]
    assert [(p.part, p.hit) for p in parts] == [("a", False), ("X", True), ("b", False), ("x", True), ("c", False)]
    assert one(spark, text.snake_case(lit("Works At!")), text.snake_case(lit("--"))) == ["works_at", "related_to"]
    assert one(spark, text.render("Hi $name, $n", name=lit("Bo"), n=lit(3))) == ["Hi Bo, 3"]


def test_wiki_text(spark):
    df = spark.createDataFrame([("S [^a] [^b] [[Soft Max|sm]] [[Nope]]", ["a"], {"soft max": "softmax p1"})], "b string, ok array<string>, t map<string,string>")
    v = df.select(text.validate_citations(F.col("b"), F.col("ok")).alias("v"), text.resolve_links("b", "t").alias("l")).first()
    assert v.v.text == "S [^a] [[Soft Max|sm]] [[Nope]]" and v.v.kept == ["a"]
    assert v.l.text == "S [^a] [^b] [[softmax|sm]] Nope" and v.l.linked == ["p1"]


def test_vectors_and_models(spark):
    v = one(spark, text.truncate_normalize(F.array(F.lit(3.0), F.lit(4.0), F.lit(9.0)), 2))[0]
    assert v == [0.6, 0.8]
    a, b = models.HashEmbedder().embed(["Red fox", "fox red"])
    assert a == b and abs(sum(x * x for x in a) - 1) < 1e-9
    f, out = models.ThinkFilter(), []
    for piece in ["a<th", "ink>hid", "den</thi", "nk>b<", "c"]:
        out.append(f.feed(piece))
    assert "".join(out) + f.flush() == "ab<c"
    assert models.signature_mismatch(None, "x") is None and models.signature_mismatch("y", "x")
    ask = models.complete_column(models.KeywordExtractor({"fox": ("Fox", "Organism", "d", [])}))
    df = spark.createDataFrame([("a fox",)], "p string")
    assert '"Fox"' in df.select(ask("p").alias("r")).first().r.reply
