"""Rate limits: the batch form, the ring of the stream, and granted starts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillgraph.streaming import jobs, limits

SCHEMA = "limiter string, id long, ts timestamp"


def rows(seed=1, n=500):
    rnd = random.Random(seed)
    us = [rnd.choice([0, 60_000_000]) + rnd.randrange(0, 240) * 1_000_000 // 2 + rnd.choice([0, 1, 499_999, 999_999]) for _ in range(n)]
    return [(f"l{k % 3}" if k % 5 else "hot", k, u) for k, u in enumerate(us)]


def frame(spark, data):
    return spark.createDataFrame(data, "limiter string, id long, us long").select("limiter", "id", F.timestamp_micros("us").alias("ts"))


def counted(data):
    return {i: sum(m == lim and u - 60_000_000 < v <= u for m, _, v in data) for lim, i, u in data}


def test_batch_equals_recount(spark):
    data = rows()
    got = {r.id: r.in_window for r in limits.in_window(frame(spark, data)).collect()}
    assert got == counted(data)
    assert {r.id for r in limits.over_rate(frame(spark, data), 40).collect()} == {i for i, n in got.items() if n > 40}
    edge = frame(spark, [("l", k, t * 1_000_000) for k, t in enumerate((0, 10, 59, 60, 61, 60))])
    assert {r.id: r.in_window for r in limits.in_window(edge).collect()} == {0: 1, 1: 2, 2: 3, 3: 4, 4: 5, 5: 4}
    untimed = edge.union(spark.createDataFrame([("l", 9, None)], SCHEMA))
    assert {r.id: r.in_window for r in limits.in_window(untimed).collect()}[9] is None
    before_1970 = frame(spark, [("l", 0, -1), ("l", 1, 59_999_998), ("l", 2, 59_999_999)])
    assert {r.id: r.in_window for r in limits.in_window(before_1970).collect()} == {0: 1, 1: 2, 2: 2}


def test_windows_stay_within_seconds_and_minutes(spark):
    plan = limits.over_rate(frame(spark, rows()), 3)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.split("\n") if "windowspecdefinition" in x]
    assert windows
    # a limiter alone is never the key: a second or a minute stands beside it
    for x in windows:
        for spec in re.findall(r"windowspecdefinition\(([^)]*)", x):
            parts = [p.split("#")[0].strip() for p in spec.split(",")]
            assert parts[0] == "limiter" and parts[1] != "_us" and "ASC" not in parts[1], spec


def streamed(spark, tmp_path, data, make, name):
    pytest.importorskip("google.protobuf", reason="stateful processors need protobuf")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for k in range(0, len(data), max(1, len(data) // 4)):
        frame(spark, data[k : k + max(1, len(data) // 4)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return jobs.collect_once(make(source), name, "append", str(tmp_path / "ck")).collect()


def test_stream_equals_batch(spark, tmp_path):
    data = sorted(rows(2), key=lambda r: (r[2], r[1]))
    # equal times stay in one micro-batch, as they count one another
    data = [(m, i, u + i) for m, i, u in data]
    data.sort(key=lambda r: r[2])
    got = {(r.id, r.in_window) for r in streamed(spark, tmp_path, data, lambda s: limits.over_rate_stream(s, 20), "over_rate")}
    want = {(i, n) for i, n in counted(data).items() if n > 20}
    assert got == want and want


def test_grants(spark, tmp_path):
    asked = [("l", 0, 0), ("l", 1, 0), ("l", 2, 0), ("l", 3, 119_000_000), ("l", 4, 119_000_000), ("m", 5, 7_000_000)]
    out = {r.id: r.waited for r in streamed(spark, tmp_path, asked, lambda s: limits.grant_stream(s, 2), "grants")}
    assert out == {0: 0.0, 1: 0.0, 2: 60.0, 3: 0.0, 4: 1.0, 5: 0.0}
