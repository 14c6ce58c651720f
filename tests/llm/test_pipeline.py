import random

import corpus_pipeline
from quillgraph.llm import mixing, pii, simhash, stages
from quillgraph.llm.queries import QUERIES, SQL

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def write(spark, folder, rows, labels):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_stages(spark, tmp_path):
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(words[(i * 7 + k * (i + 1)) % 40] + str(i) for k in range(30)), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100 + i, rows[3][1], "en", "s0", 1) for i in range(5)]
    rows += [(200, "idiot scum loser you idiot", "en", "s1", 1), (201, "mail me a@b.co at once " + rows[9][1], "en", "s2", 1), (202, None, None, None, None)]
    write(spark, str(tmp_path), rows, [(1, 1, 0)])
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == COLUMNS
    ids = lambda name: {r.doc_id for r in seen[name]}
    assert ids("toxicity") == {r[0] for r in rows} - {200}
    assert len(seen["simhash"]) == len(ids("simhash")) and 3 in ids("simhash") and not ids("simhash") & set(range(100, 105))
    fps = [simhash.fingerprint(r.text) for r in seen["simhash"]]
    assert all((a ^ b).bit_count() > 3 for i, a in enumerate(fps) for b in fps[:i])
    assert any("<email>" in (r.text or "") for r in seen["pii"]) and not any(pii.find(r.text)[0] for r in seen["pii"])
    assert len(seen["mixing"]) > 20 and ids("mixing") <= ids("pii")
    assert sum(r.length for r in seen["packing"]) > 0
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda rows: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows)
    assert key(again) == key(seen["packing"])


def test_empty_pipeline(spark, tmp_path):
    write(spark, str(tmp_path), [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_without_ids(spark):
    """Distinct texts without an id stay; copies fall to one; mixing takes each as often as planned."""
    r = random.Random(8)
    texts = [" ".join(f"w{r.randrange(999)}" for _ in range(40)) for _ in range(12)]
    rows = [(None, t, "en", "s", 1) for t in texts] + [(None, texts[0], "en", "s", 1)] * 3 + [(7, texts[1], "en", "s", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = stages.drop_near_duplicates(spark, docs, "").collect()
    groups = {r.root for r in simhash.grouped(simhash.with_fingerprints(docs), root=True).collect()}
    assert len({r.text for r in kept}) == len(kept) == len(groups) and [r.doc_id for r in kept if r.doc_id] == [7]
    mixed = mixing.mix(docs).collect()
    out = stages.mix_sources(spark, docs, "").collect()
    assert len(out) == sum(r.epochs for r in mixed) == len(rows)


def test_registered():
    assert [q.split("_")[0] for q in QUERIES] == [f"op{i}" for i in range(1, 11)] and set(SQL) <= set(QUERIES)
