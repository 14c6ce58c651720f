import math
import random
import zlib
from collections import Counter
from fractions import Fraction

from pyspark.sql import functions as F

from quillgraph.llm import common, sharding
from quillgraph.llm.sharding import communication_matrix, hypergeometric, shard_documents

SCHEMA = "doc_id long, text string, shard int"  # a clashing extra column


def rows_of(spark, rows, schema=SCHEMA):
    return shard_documents(spark.createDataFrame(rows, schema)).collect()


def test_matrix_margins():
    m = communication_matrix([5, 0, 100, 17], [31, 31, 30, 30], 3)
    assert [sum(r) for r in m] == [5, 0, 100, 17]
    assert [sum(c) for c in zip(*m)] == [31, 31, 30, 30]


def test_hypergeometric_mean():
    rng = random.Random(1)
    draws = [hypergeometric(rng, 60, 40, 30) for _ in range(3000)]
    assert abs(sum(draws) / 3000 - 18) < 0.2
    assert min(draws) >= 0 and max(draws) <= 30


def test_exact_sizes_and_gapless_slots(spark):
    rows = [(i, f"text {i}", 0) for i in range(1003)]
    out = rows_of(spark, rows)
    sizes = Counter(r.shard for r in out)
    assert sorted(sizes) == list(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n))
    assert all(r.size == len(f"text {r.doc_id}") + 1 and r.text_crc32 == zlib.crc32(f"text {r.doc_id}".encode()) for r in out)
    assert {tuple(r) for r in out} == {tuple(r) for r in rows_of(spark, rows[::-1])}  # reruns agree


def test_nulls_copies_and_ties(spark):
    rows = [(1, None, 0), (1, None, 0), (None, "", 0), (2, "é" * 5000, None)] + [(3, "same", 1)] * 50
    out = rows_of(spark, rows)
    assert len(out) == 54 and Counter(r.shard for r in out).most_common(1)[0][1] <= 4
    assert {(r.size, r.text_crc32) for r in out if r.doc_id == 1} == {(1, 0)}
    assert next(r.size for r in out if r.doc_id == 2) == 10001


def test_empty(spark):
    assert rows_of(spark, []) == []


def test_draws_follow_the_exact_law():
    """Chi-square of draws against the probabilities by integers, also far out."""
    rng = random.Random(5)
    for good, bad, draws in [(5, 7, 4), (3, 40, 20), (30, 10, 25), (1, 1, 1)]:
        total = math.comb(good + bad, draws)
        n = 20_000
        seen = Counter(hypergeometric(rng, good, bad, draws) for _ in range(n))
        chi = cells = 0
        for k in range(max(0, draws - bad), min(good, draws) + 1):
            want = n * math.comb(good, k) * math.comb(bad, draws - k) / total
            if want > 5:
                chi += (seen[k] - want) ** 2 / want
                cells += 1
        assert chi < cells + 5 * math.sqrt(2 * cells) + 5, (good, bad, draws, chi)


def test_probabilities_are_exact():
    for good, bad, draws, k in [(5000, 7000, 3000, 1250), (40, 60, 50, 20), (20_000, 10, 5, 5)]:
        want = Fraction(math.comb(good, k) * math.comb(bad, draws - k), math.comb(good + bad, draws))
        got = Fraction(sharding._probability(good, bad, draws, k))
        assert abs(got - want) < want * Fraction(1, 10**35)
    # a matrix of 1e11 rows: moments as the law has them
    rng, good, bad, draws = random.Random(1), 10**10, 9 * 10**10, 10**7
    sample = [hypergeometric(rng, good, bad, draws) for _ in range(300)]
    p = good / (good + bad)
    sd = math.sqrt(draws * p * (1 - p))
    mean = sum(sample) / 300
    assert abs(mean - draws * p) < 4 * sd / math.sqrt(300) and 0.85 < math.sqrt(sum((x - mean) ** 2 for x in sample) / 300) / sd < 1.15


def test_shuffle_is_uniform(spark):
    """Places before and after the shuffle are independent: shards, slots, neighbours."""
    n = 24_000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("same size").alias("text"))
    out = sorted((r.doc_id, r.shard, r.slot) for r in shard_documents(df).collect())
    per = n // 16
    cells = Counter((i * 12 // n, s * per + t) for i, s, t in out for s, t in [(s, t)])
    grid = Counter((a, b * 24 // n) for a, b in cells)
    want = n / (12 * 24)
    chi = sum((grid[a, b] - want) ** 2 / want for a in range(12) for b in range(24))
    degrees = 11 * 23
    assert abs(chi - degrees) < 5 * math.sqrt(2 * degrees)
    together = sum(x[1] == y[1] for x, y in zip(out, out[1:], strict=False)) / (n - 1)
    assert abs(together - 1 / 16) < 5 * math.sqrt(1 / 16 / n)


def test_all_rows_alike(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 100)
    df = spark.createDataFrame([(1, "same")] * 500, "doc_id long, text string")
    out = shard_documents(df).collect()
    counts = Counter(r.shard for r in out)
    assert len(out) == 500 and len({(r.shard, r.slot) for r in out}) == 500 and max(counts.values()) - min(counts.values()) <= 1
    again = shard_documents(df.repartition(5)).collect()
    assert {tuple(r) for r in out} == {tuple(r) for r in again}
    copies = sharding.numbered(df.repartition(3), ["doc_id", "text"]).collect()
    assert sorted(r._qs_copy for r in copies) == list(range(500))
