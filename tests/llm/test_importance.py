import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from quillgraph.llm import importance
from quillgraph.llm.importance import advance, resample, resample_documents, scan

WORDS = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, buckets string, rank string, part long"


def features(text, longest=1):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    w = WORDS.findall(low)
    return w, [b" ".join(w[i : i + n]) for i in range(len(w)) for n in range(1, longest + 1) if i + n <= len(w)]


def scanned(texts, longest=1):
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    return scan(np.frombuffer(b"".join(data), np.uint8), offsets, longest)


@given(st.lists(st.text(alphabet="aZ9 é中.-\n\U0001f600", max_size=30), max_size=6), st.integers(1, 3))
def test_scan_equals_the_pattern(texts, longest):
    n_words, n_features, crc = scanned(texts, longest)
    want = [features(t, longest) for t in texts]
    assert n_words.tolist() == [len(w) for w, _ in want] and n_features.tolist() == [len(f) for _, f in want]
    assert crc.tolist() == [zlib.crc32(x) for _, f in want for x in f]


def test_words_end_at_documents_and_long_words_end_apart():
    texts = ["ab", "cd", "", "x" * 70_000 + " " + "y" * 3, "é" * 500] + ["word"] * 20
    assert scanned(texts)[2].tolist() == [zlib.crc32(t) for x in texts for t in features(x)[0]]
    assert len(advance(np.zeros(0, np.uint32), np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


def brute(docs, target, percent=10, least=20, buckets=10_000, longest=1):
    both = [Counter(zlib.crc32(x) % buckets for t in side for x in features(t, longest)[1]) for side in ([t for _, t in docs], target)]
    s_all, t_all = (sum(c.values()) for c in both)
    gain = lambda b: math.floor(1000 * math.log((both[1][b] + 1) * (s_all + buckets) / ((both[0][b] + 1) * (t_all + buckets))))
    rows = []
    for i, t in docs:
        w, f = features(t, longest)
        weight = sum(gain(zlib.crc32(x) % buckets) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in rows), key=str)


def texts(rnd, n):
    vocabulary = ["".join(rnd.choice("abcdeéß9") for _ in range(rnd.randint(1, 7))) for _ in range(300)]
    return [rnd.choice([" ", ", ", "\n"]).join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 90))) for _ in range(n)], vocabulary


@pytest.mark.parametrize("longest", [1, 2])
def test_against_brute_force(spark, monkeypatch, longest):
    monkeypatch.setattr(importance, "SLICE", 700)
    rnd = random.Random(5)
    some, vocabulary = texts(rnd, 300)
    docs = list(enumerate(some))
    docs += [(7, some[3])] * 40 + [(None, some[4]), (None, some[4]), (900, None), (901, ""), (902, "..."), (903, "long " * 3000)]
    target = [" ".join(rnd.choice(vocabulary[:50]) for _ in range(30)) for _ in range(20)] + [None, ""]
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in docs], SCHEMA).repartition(5)
    out = resample(df, spark.createDataFrame([(t,) for t in target], "text string"), longest=longest)
    got = sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in out.collect()), key=str)
    assert got == brute(docs, target, longest=longest)


def test_empty_sides(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert resample_documents(none, none).collect() == []
    some = spark.createDataFrame([(1, "a b", "", "", 0)], SCHEMA)
    assert [tuple(r) for r in resample_documents(some, none).collect()] == brute([(1, "a b")], [])
    assert resample_documents(some, none).columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_hot_rows_are_spread(spark):
    """Nine tenths of the rows are one row: no range holds over twice the mean."""
    rows = spark.range(20_000).selectExpr("if(id % 10 = 0, id, 5) AS doc_id", "if(id % 10 = 0, concat('w', id, repeat(' word', 30)), repeat('same ', 30)) AS text")
    from quillgraph.llm.common import numbered

    out = numbered(rows, ["doc_id", "text"], "place")
    sizes = [r["count"] for r in out.groupBy("part").count().collect()]
    assert max(sizes) <= 2 * 20_000 / len(sizes)
    assert sorted(r.place for r in out.select("place").collect()) == list(range(20_000))
