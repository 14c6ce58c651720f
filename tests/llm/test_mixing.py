import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillgraph.llm.mixing import SCHEDULES, demand_at, mix, mix_documents, placed, range_sorted, time_of

SCHEMA = "doc_id long, text string, source string, size int, target int"


def brute_targets(sizes, cap=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        above = [s for s in rest if share[s] > cap * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in above}


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2) for i, t, s in rows], SCHEMA)


def test_targets_and_taken(spark):
    rnd = random.Random(6)
    rows, sources = [], ["a", "b", "Z", "é", "hot", None, "zz"]
    for i in range(900):
        s = rnd.choice(sources + ["hot"] * 5)
        rows.append((i, "w " * rnd.choice([0, 1, 20, 300]), s))
    rows += [(5000, None, "a"), (5001, "  ", "never"), (5002, "x", "tiny")]
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(dict(sizes))
    out = mix(docs_of(spark, rows)).collect()
    assert len(out) == len(rows)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.size * r.epochs <= 3 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s], s
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    key = lambda rows: sorted((r.doc_id, r.taken, r.begin) for r in rows)
    assert key(out) == key(mix(docs_of(spark, rows[::-1]).repartition(3)).collect())


def test_schedules_invert(spark):
    df = spark.range(0, 101).select((F.col("id") / 100.0).alias("p"))
    for knots in SCHEDULES:
        out = df.withColumn("t", time_of(F.col("p"), knots)).withColumn("back", demand_at(F.col("t"), knots)).orderBy("p").collect()
        assert all(abs(r.p - r.back) < 1e-9 for r in out) and [r.t for r in out] == sorted(r.t for r in out)
    early, late = (df.select(time_of(F.lit(0.5), k).alias("t")).first().t for k in (SCHEDULES[0], SCHEDULES[2]))
    assert early < 0.5 < late


def test_positions(spark):
    rows = [(i, "w " * (i % 7 + 1), "abc"[i % 3]) for i in range(300)]
    mixed = mix(docs_of(spark, rows))
    places = placed(mixed).collect()
    assert len(places) == sum(r.epochs for r in mixed.collect())
    total = sum(i % 7 + 1 for i in range(300))
    assert all(0 <= r.position <= total + 1e-6 for r in places)
    first = mix_documents(docs_of(spark, rows)).collect()
    assert len(first) == 300 and {r.doc_id for r in first if r.position is not None} == {r.doc_id for r in places}


def test_repeats_and_empty(spark):
    out = mix_documents(docs_of(spark, [(1, "a b", "s")] * 4 + [(2, None, None)])).collect()
    assert len(out) == 5 and sum(r.taken for r in out) == 8
    assert mix_documents(docs_of(spark, [])).collect() == []


def test_order_and_many_sources(spark):
    """Positions ascend over the partitions; ranks follow code points over several tasks."""
    rows = [(i, "w " * (1 + i % 7), f"s{i % 211}") for i in range(2000)]
    out = mix_documents(docs_of(spark, rows))
    places = [r.position for r in out.collect() if r.position is not None]
    assert places == sorted(places) and len(places) > 500
    mixed = mix(docs_of(spark, rows)).select("source", "rank").distinct().collect()
    assert [r.source for r in sorted(mixed, key=lambda r: r["rank"])] == sorted({r[2] for r in rows})


def test_rows_without_ids_are_spread(spark):
    rows = [(None, f"w{i} x", "s") for i in range(500)]
    out = mix(docs_of(spark, rows)).collect()
    assert sorted(r.begin for r in out) == [2 * i for i in range(500)]


def test_rows_left_out_are_spread(spark):
    """Nine tenths of the rows have no position: no range holds over twice the mean."""
    rows = spark.range(20_000).selectExpr("id AS doc_id", "if(id % 10 = 0, double(id), null) AS position")
    out = range_sorted(rows)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 2 * 20_000 / len(sizes) and out.columns == ["doc_id", "position"]
    in_order = [r.position for r in out.collect()]
    assert in_order == sorted(in_order, key=lambda x: (x is not None, x or 0))
