import random
import zlib
from collections import defaultdict

import numpy as np

from quillgraph.llm.packing import best_fit, pack, pack_documents
from quillgraph.llm.tokens import encoder

SCHEMA = "doc_id long, text string, bin string, offset long"


def check(rows, texts, capacity=1024):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for d, pieces in by_doc.items():
        ids = np.frombuffer(encoder("byte_bpe_50k.json").encode([texts[d]])[0], dtype="<u4").tolist() + [2]
        pieces.sort(key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        assert len(pieces) == -(-len(ids) // capacity)
        at = 0
        for p in pieces:
            assert p.start == at and p.length <= capacity and (p.piece == 0 or p.length == capacity)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], dtype="<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    return by_seq


def test_best_fit():
    where, offset, fill = best_fit([6, 5, 5, 4, 10], 10)
    assert sorted(fill) == [10, 10, 10] and where[0] == where[3] and offset[3] == 6


def test_documents(spark):
    rnd = random.Random(2)
    texts = {i: " ".join(rnd.choice(["lorem", "ipsum", "da", "x!"]) for _ in range(rnd.choice([1, 50, 300, 700, 3000]))) for i in range(300)}
    texts |= {1000: None, 1001: "", 1002: "a " * 20000}
    df = spark.createDataFrame([(k, v, "b", 1) for k, v in texts.items()], SCHEMA)
    by_seq = check(pack_documents(df).collect(), texts)
    total = sum(p.length for s in by_seq.values() for p in s)
    assert len(by_seq) <= -(-total // 1024) * 1.02 + 1


def test_tree_of_small_groups(spark):
    rnd = random.Random(4)
    texts = {i: "a" + " a" * rnd.randrange(1000) for i in range(400)}
    df = spark.createDataFrame([(k, v, None, 1) for k, v in texts.items()], SCHEMA).repartition(4)
    rows = pack(df, group_items=30).collect()
    bins = defaultdict(list)
    for r in rows:
        bins[r.bin].append(r)
    assert len({(r.doc_id, r.piece) for r in rows}) == len(rows) == 400
    for pieces in bins.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
    total = sum(r.length for r in rows)
    assert len(bins) <= -(-total // 1024) * 1.1 + 1


def test_tree_loses_no_saving(spark):
    """One bin of half its capacity or less is left at most, as in one best-fit run."""
    rnd = random.Random(6)
    for trial in range(3):
        texts = {i: "a" + " a" * rnd.choice([2, 40, 200, 430, 700]) for i in range(150)}
        df = spark.createDataFrame([(k, v, None, 1) for k, v in texts.items()], SCHEMA).repartition(5)
        rows = pack(df, group_items=7 + trial, fan_in=2 + trial).collect()
        fills = defaultdict(int)
        for r in rows:
            fills[r.bin] += r.length
        small = [f for f in fills.values() if f <= 512]
        free = sorted((1024 - f for f in fills.values()), reverse=True)
        assert len(rows) == 150 and max(fills.values()) <= 1024 and len(small) <= 1
        assert not small or free[0] == 1024 - small[0] and (len(free) == 1 or free[1] < small[0])


def test_batches_larger_than_a_group(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100000")
    try:
        texts = dict.fromkeys(range(3000), "a b")
        df = spark.createDataFrame([(k, v, "", 0) for k, v in texts.items()], SCHEMA).coalesce(1)
        rows = pack(df, group_items=100).withColumnRenamed("bin", "sequence_id").collect()
        check(rows, texts)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_repeated_rows_and_empty(spark):
    out = pack_documents(spark.createDataFrame([(1, "same", "", 0)] * 5, SCHEMA)).collect()
    assert len(out) == 5 and len({(r.sequence_id, r.offset) for r in out}) == 5
    assert pack_documents(spark.createDataFrame([], SCHEMA)).collect() == []
