"""Exact top-k inner-product search over quantised vectors.

Queries are dealt into blocks and vectors into shards; a cell of the grid is one
block against one shard, and an exchange brings both to it, the queries first.  A
task holds a cell's queries and the best ``k`` so far of each, and streams the
vectors past them as tiles: matrix products with a partial selection.  The cells'
lists of a query are merged as a tree: by groups of shards, then fewer groups.

The grid follows from both counts.  Queries are sent once a shard and vectors once
a block, so blocks and shards grow with the square roots of the counts, which keeps
both flows far below the product; a block is bounded by what a task can hold.
Nothing is broadcast or collected.

Scores are exact integers: products run in float64 where every partial sum
stays below 2**53, in int64 below 2**63, else in Python integers, of which what
exceeds a long is held at the limits of the type.

Defined results
* vectors that are null or hold null, NaN or infinite components take no part,
  neither as queries nor as candidates; so do empty vectors and null ids.
* vectors of different lengths don't meet.
* ties go to the smaller vec_id.  Repeated rows are candidates each; a query's
  own id is never a candidate.  An id that repeats asks once for each distinct
  vector, and its lists are merged into one of ``k``.
* fewer than ``k`` candidates: all of them.  Empty table: no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

SCALE = 1024
#: Queries of a block and vectors of a shard: at least, and by square root.
QUERIES_LEAST, QUERIES_MOST, SHARD_LEAST, GROWTH = 4096, 65_536, 8192, 16
#: Scores of one tile.
BLOCK_SCORES = 2_000_000
FAN_IN = 32
PARTIAL = "query_id long, vec_id long, score long, part long"


def usable(vectors: DataFrame) -> DataFrame:
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.col("vec_id").isNotNull())
    return rows.where(~bad).select("vec_id", F.col("embedding").alias("v"))


def quantise(rows: list) -> np.ndarray:
    """floor(1024 x) of a matrix; Python integers where a double isn't exact in int64."""
    x = np.floor(SCALE * np.array(rows, dtype=np.float64))
    if np.isfinite(x).all() and np.abs(x).max(initial=0) < 2**53:
        return x
    exact = [[math.floor(SCALE * v) if math.isfinite(SCALE * v) else int(v) * SCALE for v in r] for r in rows]
    return np.array(exact, dtype=object)


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows, as int64."""
    bound = q.shape[1] * max(1, int(np.abs(q).max(initial=0))) * max(1, int(np.abs(v).max(initial=0)))
    if bound < 2**53:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    if bound < 2**63:
        return q.astype(np.int64) @ v.astype(np.int64).T
    exact = q.astype(object) @ v.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row by (score desc, id asc), in any order; ids ascend."""
    n = scores.shape[1]
    if n <= k:
        return scores, np.broadcast_to(ids, scores.shape)
    if np.abs(scores).max(initial=0) < (1 << 62) // n:  # one key of score and column
        key = scores * n + np.arange(n - 1, -1, -1)
        at = np.argpartition(key, n - k, axis=1)[:, n - k :]
    else:
        at = np.stack([np.lexsort((ids, ~r))[:k] for r in scores])
    return np.take_along_axis(scores, at, axis=1), ids[at]


class Cell:
    """One block's queries, and their best so far."""

    def __init__(self, number: int, k: int):
        self.number, self.k, self.asked, self.ready, self.tops = number, k, {}, None, {}

    def ask(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        self.asked.setdefault(matrix.shape[1], []).append((ids, matrix))

    def meet(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        if self.ready is None:
            self.ready = {d: (np.concatenate([x for x, _ in parts]), quantise(np.concatenate([m for _, m in parts]))) for d, parts in self.asked.items()}
        d = matrix.shape[1]
        if d not in self.ready:
            return
        qid, q = self.ready[d]
        order = np.argsort(ids, kind="stable")
        ids, v = ids[order], quantise(matrix[order])
        step = max(self.k, BLOCK_SCORES // len(qid))
        for at in range(0, len(ids), step):
            some = ids[at : at + step]
            own = qid[:, None] == some[None, :]
            s, i = best(products(q, v[at : at + step]), some, self.k + int(own.sum(1).max(initial=0)))
            self.tops[d] = _merge(self.tops.get(d), qid, s, i, self.k)

    def lists(self, cols: int):
        for d, (s, i, valid) in self.tops.items():
            r, c = np.nonzero(valid)
            part = np.full(len(r), self.number // cols, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(self.ready[d][0][r]), pa.array(i[r, c]), pa.array(s[r, c]), pa.array(part)], names=["query_id", "vec_id", "score", "part"])


def _merge(so_far, qid: np.ndarray, s: np.ndarray, i: np.ndarray, k: int):
    """Merge new lists into the kept ones; a query's own id drops out."""
    valid = i != qid[:, None]
    if so_far is not None:
        s, i, valid = (np.concatenate(x, axis=1) for x in zip(so_far, (s, i, valid), strict=True))
    order = np.lexsort((i, -s.astype(np.float64) if np.abs(s).max(initial=0) < 2**53 else _descending(s), ~valid), axis=1)[:, :k]
    return tuple(np.take_along_axis(x, order, axis=1) for x in (s, i, valid))


def _descending(s: np.ndarray) -> np.ndarray:
    return ~s  # order-reversing over all of int64


def _search(k: int, cols: int):
    def run(batches):
        cell = None
        for b in batches:
            numbers, kinds, ids = (b.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "kind", "vec_id"))
            rows = b.column("v")
            starts = rows.offsets.to_numpy()
            flat, lengths = rows.values.to_numpy(zero_copy_only=False), np.diff(starts)
            change = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(kinds) != 0) | (np.diff(lengths) != 0)) + 1
            for at, end in zip([0, *change], [*change, len(ids)], strict=True):
                if at == end:
                    continue
                if cell is None or numbers[at] != cell.number:
                    if cell:
                        yield from cell.lists(cols)
                    cell = Cell(int(numbers[at]), k)
                matrix = flat[starts[at] : starts[end]].reshape(end - at, lengths[at])
                (cell.meet if kinds[at] else cell.ask)(ids[at:end], matrix)
        if cell:
            yield from cell.lists(cols)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block_queries: int | None = None, shard_rows: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for every row of ``queries`` (vec_id, embedding)."""
    rows = usable(vectors)
    asked = materialize(usable(queries).distinct(), "topk-queries")
    n, m = asked.count(), rows.count()
    block = block_queries or min(QUERIES_MOST, max(QUERIES_LEAST, int(GROWTH * n**0.5)))
    shard = shard_rows or max(SHARD_LEAST, int(GROWTH * m**0.5))
    cols, shards = max(1, -(-n // block)), max(1, -(-m // shard))
    column = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    q = asked.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", "v"), F.lit(cols)).alias("col"), column(shards).alias("shard"), F.lit(0).alias("kind"))
    # rows are dealt in turn, so copies of one vector spread over the shards
    v = rows.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards))).select("vec_id", "v", column(cols).alias("col"), "shard", F.lit(1).alias("kind"))
    cells = q.unionByName(v).select((F.col("shard") * cols + F.col("col")).cast("long").alias("cell"), "kind", "vec_id", "v")
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = cells.repartition(parts, "cell").sortWithinPartitions("cell", "kind", F.size("v"))
    order = [F.col("score").desc(), F.col("vec_id").asc()]
    partial = materialize(dealt.mapInArrow(_search(k, cols), PARTIAL), "topk-partial")
    groups = shards
    while groups > FAN_IN:
        groups = -(-groups // FAN_IN)
        partial = partial.withColumn("part", F.pmod("part", F.lit(groups)))
        level = Window.partitionBy("query_id", "part").orderBy(*order)
        partial = partial.withColumn("rank", F.row_number().over(level)).where(F.col("rank") <= k).drop("rank")
    last = Window.partitionBy("query_id").orderBy(*order)
    return partial.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_embeddings(vectors: DataFrame) -> DataFrame:
    """Digest form: ids divisible by 100 ask, all rows answer."""
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
