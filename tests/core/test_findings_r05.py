"""Search in chunks that aren't indexed: no postings are made, and no join moves the chunks."""

import math
import os
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgraph.functions import models
from quillgraph.operators import blockmax, retrieve, search
from quillgraph.plans.text_queries import Q

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_score_like_postings(spark):
    """F16: null, empty and repeated texts, ties, questions without words or hits."""
    texts = ["red fox", "Fox fox den", None, "", "...", "red fox", "Straße fox Éa_1", "den " * 40, "blue sky red sky"]
    for key, name in (("chunk_id", lambda i: f"d:{i:05}"), ("doc_id", int)):
        kind = "string" if key == "chunk_id" else "long"
        docs = spark.createDataFrame([(name(i), t) for i, t in enumerate(texts)], f"{key} {kind}, text string").repartition(3)
        q = spark.createDataFrame([(1, "fox red"), (2, "STRASSE straße éa_1"), (3, "nowhere"), (4, ""), (5, None), (6, "den sky sky")], "query_id long, text string")
        for k in (1, 2, 20):
            want = search.bm25(search.postings(docs, key), q, k, key, search.lengths(docs, key))
            got = search.bm25_texts(docs, q, k, key)
            rows = lambda df: sorted((r.query_id, r.rank, r[key], r.score) for r in df.collect())  # noqa: B023, E731
            assert rows(got) == rows(want) and rows(got)
    assert search.bm25_texts(docs.limit(0), q, 3, "doc_id").collect() == [] == search.bm25_texts(docs, q.limit(0), 3, "doc_id").collect()


def test_questions_in_blocks_meet_all_texts(spark, monkeypatch):
    from quillgraph.operators import sparse

    monkeypatch.setattr(sparse, "grid", lambda *_: (3, 4))
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} x") for i in range(60)], "doc_id long, text string")
    q = spark.createDataFrame([(i, f"w{i} x") for i in range(8)], "query_id long, text string")
    want = search.bm25(search.postings(docs, "doc_id"), q, 9, "doc_id", search.lengths(docs, "doc_id"))
    got = search.bm25_texts(docs, q, 9, "doc_id")
    assert sorted(map(tuple, got.select("query_id", "doc_id", "score", "rank").collect())) == sorted(map(tuple, want.select("query_id", "doc_id", "score", "rank").collect()))


def test_embedder_remembers_words():
    models._bucket.cache_clear()
    models.HashEmbedder().embed(["a b", "b a a"])
    assert models._bucket.cache_info().misses == 2


def no_postings(monkeypatch):
    def made(*_, **__):
        raise AssertionError("postings are made")

    monkeypatch.setattr(search, "postings", made)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
def test_hybrid_retrieval_makes_no_postings(spark, monkeypatch):
    no_postings(monkeypatch)
    assert Q["hybrid_retrieval"](spark, SF).count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
def test_windows_make_no_postings(spark, monkeypatch):
    """F31"""
    no_postings(monkeypatch)
    assert Q["neighbor_window_merge"](spark, SF).count()


def test_windows_move_no_chunks(spark):
    """the few hits go to the chunks."""
    hits = spark.range(3).selectExpr("id query_id", "concat('d:0000', id) chunk_id", "1.0D score", "1 rank").repartition(2)
    chunks = spark.range(9).selectExpr("concat('d:0000', id) chunk_id", "'d' doc_id", "cast(id AS int) idx", "array() headings", "concat('t', id) text", "1 page_start", "'p' path").repartition(2)
    out = retrieve.chunk_windows(hits, chunks, 1)
    plan = plan_of(out)
    assert "hashpartitioning(chunk_id" not in plan and "hashpartitioning(doc_id" not in plan and "BroadcastHashJoin" in plan
    assert sorted((r.query_id, r.ref, r.text) for r in out.collect()) == [(0, "d:00000", "t0\nt1"), (1, "d:00001", "t0\nt1\nt2"), (2, "d:00002", "t1\nt2\nt3")]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
def test_budget_fold_makes_no_postings(spark, monkeypatch):
    """F23"""
    no_postings(monkeypatch)
    assert Q["combined_budget_fold"](spark, SF).count()


def test_blocks_move_texts_once(spark):
    """by range; what is made of the words stays there."""
    texts = ["a b b", "b c", None, "", "a a a d", "b", "a b c d"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1, "b a"), (1, "b b b")], "doc_id long, text string")
    asked, of = spark.createDataFrame([("a",), ("b",), ("gone",)], "term string"), F.expr("doc_id div 4")
    out = blockmax.blocks_of(docs, of, "doc_id", asked)
    assert plan_of(out).count("Exchange hashpartitioning(") == 1 and "Exchange hashpartitioning(rng" in plan_of(out)
    want = blockmax.blocks(search.postings(docs, "doc_id"), of, "doc_id", lengths=True).where("term IN ('', 'a', 'b')")
    rows = lambda df: sorted((r.term, r.rng, r.n, r.min_len, sorted((x.key, x.doc_len, x.tf if r.term else 0) for x in r.rows)) for r in df.collect())
    assert rows(out) == rows(want)
    assert blockmax.corpus_of(out).first() == blockmax.corpus_of(want).first()


def counted(docs, q, k):
    """BM25 by its formula, as the SQL groups postings."""
    tf = Counter((w, r.doc_id, len(r.text.split())) for r in docs.collect() for w in r.text.split())
    rows = {(d, n) for _, d, n in tf}
    mean, df, out = sum(n for _, n in rows) / len(rows), Counter(w for w, _, _ in tf), []
    for r in q.collect():
        score = Counter()
        for (w, d, n), f in tf.items():
            if w in r.text.split():
                score[d] += math.log(1 + (len(rows) - df[w] + 0.5) / (df[w] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean))
        best = sorted((-round(x, 6), d) for d, x in score.items())[:k]
        out += [(r.query_id, i, d, -x) for i, (x, d) in enumerate(best, 1)]
    return sorted(out)


def test_block_search_makes_no_row_for_a_question_and_a_posting(spark):
    """blocks go to the cells; rows of one key and different lengths add up."""
    words = [" ".join(f"w{(i * j) % 11}" for j in range(1 + i % 6)) for i in range(60)]
    docs = spark.createDataFrame([(i // 2 if i % 3 else i, t) for i, t in enumerate(words)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "w0 w1 w2"), (2, "w3 w7"), (3, "w10 w5 w1 w9 w0"), (4, "none")], "query_id long, text string")
    index = blockmax.cut(blockmax.blocks_of(docs, F.expr("doc_id div 4"), "doc_id", search.asked_terms(q)))
    for k in (1, 5):
        found = blockmax.search(index, q, blockmax.corpus_of(index), k, "doc_id")
        assert "hashpartitioning(query_id, rng" not in plan_of(found.hits).replace("#", ", ") and "_cell" in plan_of(found.hits)
        assert sorted((r.query_id, r.rank, r.doc_id, r.score) for r in found.hits.collect()) == counted(docs, q, k)


def test_large_tiles_are_cut_between_ranges(monkeypatch):
    rnd = np.random.default_rng(3)
    rows = [(d // 4, t, 5, d, int(rnd.integers(1, 5)), int(5 + d % 7)) for r in range(6) for t in range(5) for d in range(4 * r, 4 * r + 4) if rnd.random() < 0.7]
    table = pa.table(dict(zip(("rng", "_t", "max_tf", "_key", "_tf", "_len"), map(list, zip(*rows, strict=True)), strict=True)))
    got = []
    for limit in (10**6, 8):
        monkeypatch.setattr(blockmax, "TILE_SCORES", limit)
        cell = blockmax._Cell(3)
        cell.ask(*map(np.array, ([7, 7, 9, 9], [-1.0] * 4, [0, 1, 1, 4], [1.0, 0.5, 2.0, 1.0], [1, 0, 1, 1], [1] * 4)))
        cell._ready()
        cell.meet(table, "doc_id", 8.0)
        got.append(cell.lists("doc_id", pa.int64()).__next__().to_pydict())
    assert got[0] == got[1] and len(got[0]["_q"]) == 6


def test_chunks_with_names_are_found_in_blocks(spark):
    """keys and ranges that are strings, questions that are structs."""
    chunks = spark.createDataFrame([(f"d{i % 3}:{i // 3:05}", f"w{i % 7} w{i % 5} x" + " y" * (i % 4)) for i in range(50)], "chunk_id string, text string")
    q = spark.createDataFrame([((i, 0), f"w{i} y x") for i in range(6)], "query_id struct<query_id: int, formulation: int>, text string")
    index = blockmax.cut(blockmax.blocks(search.postings(chunks), blockmax.chunk_range(F.col("chunk_id")), "chunk_id", lengths=True))
    found = blockmax.search(index, q, blockmax.corpus_of(index), 4, "chunk_id")
    want = search.bm25_texts(chunks, q, 4)
    rows = lambda df: sorted((tuple(r.query_id), r["rank"], r.chunk_id, r.score) for r in df.collect())
    assert rows(found.hits) == rows(want) and len(rows(want)) == 24
    assert {r.step for r in found.touched.collect()} == {"all", "seeds", "essential", "verified"}
