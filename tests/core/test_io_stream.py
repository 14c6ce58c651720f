import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillgraph.sources import files
from quillgraph.streaming import jobs


def test_discover_and_read(spark, tmp_path):
    for name, body in {"a.md": "# Title\ntext", "sub/b.txt": "plain\r\nlines", "sub/.hidden/c.md": "no", "d.html": "<html><title>Tt</title><body><h1>H</h1><p>x &amp; y</p><script>no</script></body></html>", "e.bin": "no", "skip/f.md": "no"}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True, parents=True)
        p.write_bytes(body.encode())
    found = {r.path.rsplit("/", 1)[1] for r in files.discover(spark, [str(tmp_path)], excluded=["skip"]).collect()}
    assert found == {"a.md", "b.txt", "d.html"}
    docs = {r.path.rsplit("/", 1)[1]: r for r in files.read_documents(spark, [str(tmp_path)]).collect()}
    assert docs["a.md"].title == "Title" and docs["b.txt"].text == "plain\nlines" and docs["b.txt"].title == "b"
    assert docs["d.html"].title == "Tt" and docs["d.html"].text == "# H\nx & y"


def test_jsonl(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_text('{"id": "1", "question": "q"}\n\n{"id": "2", "question": "r"}\n{"id": "3", "ques')
    assert [r.id for r in files.read_jsonl(spark, str(p), files.QUESTION, recover_tail=True).collect()] == ["1", "2"]
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(p), files.QUESTION).collect()
    df = spark.createDataFrame([("x", 1)], "a string, n int")
    files.append_jsonl(df, str(tmp_path / "out"))
    files.append_jsonl(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    assert files.retire(spark, str(tmp_path / "out"), 1) and not files.retire(spark, str(tmp_path / "out"), 1)
    with pytest.raises(ValueError):
        files.write_csv(df.limit(0), str(tmp_path / "c"), require_rows=True)


def test_jsonl_keeps_whole_last_lines(spark, tmp_path):
    """A whole last line without a line end stays; a bad line inside is an error."""
    p = tmp_path / "whole.jsonl"
    p.write_text('{"id": "1"}\n{"id": "2"}')
    assert sorted(r.id for r in files.read_jsonl(spark, str(p), files.QUESTION, recover_tail=True).collect()) == ["1", "2"]
    p = tmp_path / "bad.jsonl"
    p.write_text('{"id": "1"}\n{"id": \n{"id": "3"}\n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(p), files.QUESTION, recover_tail=True).collect()


def test_reading_follows_discovery(spark, tmp_path):
    for name in ["a.MD", ".hidden/b.md", "sub/.x.md", "sub/c.md", "old/d.md"]:
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("# T\ntext " + name)
    (tmp_path / "big.txt").write_text("x" * 1000)
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.read_documents(spark, [str(tmp_path)], max_bytes=500, excluded=["old"]).collect()}
    assert set(rows) == {"a.MD", "c.md", "big.txt"} and rows["big.txt"].text is None and rows["big.txt"].error and rows["a.MD"].title == "T"


def test_uploads(spark):
    up = spark.createDataFrame([("d1", "n", "/p")], "doc_id string, name string, path string")
    new = spark.createDataFrame([("d1", "a", "/1"), ("d2", "b", "/2"), ("d2", "b", "/3"), ("d3", "c", "/4")], "doc_id string, name string, path string")
    live = spark.createDataFrame([(7, "d3", "running"), (8, "d2", "done")], "id long, fingerprint string, status string")
    out = {r.doc_id: (r.duplicate, r.job_id, r.copies) for r in files.register_uploads(up, new, live).collect()}
    assert out == {"d1": (True, None, 1), "d2": (False, None, 2), "d3": (True, 7, 1)}
    names = spark.createDataFrame([("a.md",), ("../x.md",), ("b.exe",), (".md",)], "name string")
    assert [r.accepted for r in files.accepted(names).collect()] == [True, False, False, False]


def test_stream_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(minutes=7 * i), i % 3, "ab"[i % 2], float(i), "{}") for i in range(60)]
    df = spark.createDataFrame(rows, jobs.EVENTS)
    df.write.parquet(str(tmp_path / "e"))
    batch = {tuple(r) for r in jobs.tumbling(df).collect()}
    out = jobs.collect_once(jobs.tumbling(jobs.read_events(spark, str(tmp_path / "e"))), "tumble", "complete")
    assert {tuple(r) for r in out.collect()} == batch
    assert jobs.sessions(df, "30 minutes").count() == 3


def test_queue_state(spark, tmp_path):
    try:
        import google.protobuf  # noqa: F401
    except ImportError:
        pytest.skip("stateful processors need protobuf")
    rows = [("/a", "f1", 1, "enqueue"), ("/a", "f1", 2, "claim"), ("/a", "f1", 3, "fail"), ("/a", "f2", 4, "enqueue"), ("/a", "f1", 5, "done"), ("/a", "f2", 6, "claim"), ("/a", "f2", 7, "done")]
    spark.createDataFrame(rows, "path string, fingerprint string, seq long, command string").coalesce(1).write.parquet(str(tmp_path / "q"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema("path string, fingerprint string, seq long, command string").parquet(str(tmp_path / "q"))
    out = jobs.collect_once(jobs.queue_stream(stream), "queue", "update", str(tmp_path / "ck")).orderBy("seq").collect()
    assert [(r.seq, r.fingerprint, r.status) for r in out][-1] == (7, "f2", "done")
    assert (5, "f1", "superseded") in [(r.seq, r.fingerprint, r.status) for r in out]
