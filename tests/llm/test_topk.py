import math
import random
from collections import defaultdict

from quillgraph.llm import topk
from quillgraph.llm.topk import search_embeddings, top_k

SCHEMA = "vec_id long, embedding array<float>, score long"


def brute(rows, asked, k=10):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, a in good:
        if asked(q):
            hits = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in good if c != q and len(a) == len(b))[:k]
            out[q] = [(r + 1, c, -s) for r, (s, c) in enumerate(hits)]
    return {q: h for q, h in out.items() if h}


def got(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.query_id].append((r["rank"], r.vec_id, r.score))
    return {q: sorted(h) for q, h in out.items()}


def f32(x):
    import numpy as np

    return float(np.float32(x))


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_SCORES", 50)
    monkeypatch.setattr(topk, "FAN_IN", 2)
    rnd = random.Random(3)
    rows = [(i, [f32(rnd.uniform(-1, 1)) for _ in range(6)]) for i in range(405)]
    rows += [(1000 + i, [0.5, 0.25, 0.0, -0.5, 1.0, 1.0]) for i in range(60)]  # ties
    rows += [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [math.nan] * 6), (2003, [math.inf] * 6), (2100, []), (2200, [1.0, 2.0]), (2201, [3.0, 4.0]), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA).repartition(7)
    want = brute(rows, lambda q: q % 100 == 0)
    assert got(search_embeddings(df)) == want
    assert got(top_k(df, df.where("vec_id % 100 = 0"), block_queries=2, shard_rows=50)) == want


def test_large_values_stay_exact(spark):
    rows = [(0, [1e6, -2e5]), (1, [1e6, 1e6]), (2, [1e5, 1.0]), (3, [1000001.0, 1e6]), (100, [9e5, 9e5])]
    df = spark.createDataFrame([(i, [f32(x) for x in v], 1) for i, v in rows], SCHEMA)
    out = got(search_embeddings(df))
    want = brute([(i, [f32(x) for x in v]) for i, v in rows], lambda q: q % 100 == 0)
    assert out == want and max(s for h in want.values() for _, _, s in h) > 2**53
    over = [(0, [f32(2e9), f32(2e9)]), (1, [f32(2e9), f32(2e9)])]
    assert got(search_embeddings(spark.createDataFrame([(i, v, 1) for i, v in over], SCHEMA))) == {0: [(1, 1, 2**63 - 1)]}


def test_few_and_empty(spark):
    assert got(search_embeddings(spark.createDataFrame([(0, [1.0], 0), (1, [2.0], 0)], SCHEMA))) == {0: [(1, 1, 1024 * 2048)]}
    assert search_embeddings(spark.createDataFrame([], SCHEMA)).collect() == []
