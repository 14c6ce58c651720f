import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quillgraph import runs
from quillgraph.engine import Engine
from quillgraph.streaming import jobs


def test_evaluation_goes_on_where_it_stopped(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.md").write_text("# Soft\nSoftmax normalises scores.\n")
    e = Engine(spark, f"file://{tmp_path}/store")
    log = str(tmp_path / "log")
    assert runs.measured_ingest(e, [str(tmp_path / "docs")], log)["changed"]
    assert [r.phase for r in spark.read.json(log).collect()] == ["build"]
    q = spark.createDataFrame([("1", "What does softmax do?", "it normalises", None), ("2", "Softmax scores?", None, "b")], "id string, question string, reference string, category string")
    run = runs.EvaluationRun(e, f"file://{tmp_path}/run", q, ["rag"], 2)
    assert run.run_answers() == 2 and run.run_answers() == 0

    @pandas_udf("struct<value:double,error:string>")
    def judge(metric: pd.Series, question: pd.Series, answer: pd.Series, contexts: pd.Series, reference: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"value": [1.0 if m == "faithfulness" else 0.5 for m in metric], "error": [None] * len(metric)})

    assert run.score_run(judge) == 10 and run.score_run(judge) == 0
    rows = {r.metric: r for r in run.report().collect()}
    assert rows["faithfulness"].mean == 1.0 and rows["context_recall"].skipped == 1 and rows["answer_relevancy"].ok == 2
    runs.EvaluationRun(e, f"file://{tmp_path}/run", q, ["rag"], 2)
    with pytest.raises(runs.PlanChanged):
        runs.EvaluationRun(e, f"file://{tmp_path}/run", q, ["rag"], 3)


def test_accounting(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store")
    with pytest.raises(ZeroDivisionError):
        with runs.usage_scope(e) as u:
            u.final(u.call("m", "answer", True), "ok", 30, 12)
            u.call("m", "answer", True)
            raise ZeroDivisionError
    assert (u.tokens_in, u.tokens_out) == (30, 12)
    assert sorted(r.status for r in e.read("llm_usage").collect()) == ["ok", "started"]
    assert runs.check_budget(e, 100) == 42
    with pytest.raises(runs.OverBudget):
        runs.check_budget(e, 42)


def test_waits():
    assert [runs.wait_before(n) for n in (1, 2, 3, 9)] == [1, 2, 4, 60] and runs.wait_before(1, retry_after=7) == 7
    assert runs.give_up(5, 0) and not runs.give_up(9, 0, rate_limited=True) and runs.give_up(1, 600)
    assert runs.config_hash({"answer": 1, "other": 2}) == runs.config_hash({"answer": 1}) != runs.config_hash({"answer": 2})


def test_queue_timer_ends_the_wait(spark, tmp_path):
    """A failed attempt is pending again after its delay, by a timer."""
    pytest.importorskip("google.protobuf", reason="stateful processors need protobuf")
    schema = "path string, fingerprint string, seq long, command string, error string"
    src = tmp_path / "in"
    rows = [("p", "f", 1, "enqueue", None), ("p", "f", 2, "claim", None), ("p", "f", 3, "fail", "x")]
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(src))
    stream = jobs.queue_stream(spark.readStream.schema(schema).json(str(src)), delay=1.0, timers=True)
    name = "queue_timer"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = stream.writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            got = [r.status for r in spark.table(name).orderBy("seq").collect()]
            if got.count("pending") == 2:
                break
            q.awaitTermination(1)
        assert got.count("waiting") == 1 and got.count("pending") == 2
    finally:
        q.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


class Value:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v


class Handle:
    def __init__(self):
        self.timers = []

    def getValueState(self, name, schema):  # noqa: N802
        return Value()

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.ms


def feed(processor, rows, columns, ms):
    return [tuple(r) for out in processor.handleInputRows(("p",), iter([pd.DataFrame(rows, columns=columns)]), Clock(ms)) for r in out.itertuples(index=False)]


def expire(processor, ms):
    return [tuple(r) for out in processor.handleExpiredTimer(("p",), Clock(ms), None) for r in out.itertuples(index=False)]


def test_processors():
    """The state machines themselves, with a handle and a clock of our own."""
    columns = ["fingerprint", "seq", "command"]
    q, h = jobs.QueueState(2, 30.0, True), Handle()
    q.init(h)
    out = feed(q, [("f", 1, "enqueue"), ("f", 2, "claim"), ("f", 3, "fail")], columns, 1000)
    assert [r[2] for r in out] == ["pending", "running", "waiting"] and h.timers == [31_000]
    assert feed(q, [("f", 4, "claim")], columns, 2000)[-1][2] == "waiting"
    assert [r[2] for r in expire(q, 31_000)] == ["pending"] and expire(q, 32_000) == []
    assert [r[2] for r in feed(q, [("f", 5, "claim"), ("f", 6, "fail")], columns, 33_000)] == ["running", "failed"]

    w, h = jobs.Watcher(10.0), Handle()
    w.init(h)
    feed(w, [(5, 1.0)], ["size", "mtime"], 0)
    feed(w, [(6, 2.0)], ["size", "mtime"], 4000)
    assert h.timers == [10_000, 14_000] and expire(w, 10_000) == [] and expire(w, 14_000) == [("p", 6, 2.0)]
    feed(w, [(6, 2.0)], ["size", "mtime"], 15_000)
    assert expire(w, 25_000) == [] and len(h.timers) == 2

    r = jobs.Runs()
    r.init(Handle())
    assert feed(r, [("a", 1, 5), ("a", 2, 5), ("b", 3, 1)], ["name", "seq", "tokens"], 0) == [("p", 1, "a", 2, 10)]
    assert feed(r, [("b", 4, 1), ("a", 5, 2)], ["name", "seq", "tokens"], 0) == [("p", 2, "b", 2, 2)]
