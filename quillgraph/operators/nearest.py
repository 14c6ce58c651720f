"""Nearest vectors by cosine as matrix products over a grid of cells.

Questions are dealt into blocks, vectors into shards; an exchange brings a block and
a shard together, the questions first, and a task streams the vectors past them,
keeping the best ``k`` so far of each question.  The cells' short lists are merged by
a window.  Nothing is broadcast or collected, and blocks and shards grow with the
square roots of their counts.

Scores are rounded to six places; ties go to the smaller key.  Null and empty
vectors, and those of length zero, have no score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .analytics import cut

QUESTIONS_LEAST, QUESTIONS_MOST, SHARD_LEAST, GROWTH = 2048, 65_536, 8192, 16
#: Scores of one tile, and the places they are rounded to.
TILE_SCORES, PLACES = 2_000_000, 1_000_000


def _unit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = rows.astype(np.float64)
    n = np.sqrt((x * x).sum(1))
    ok = np.isfinite(n) & (n > 0)
    return x[ok] / n[ok, None], ok


def kept_best(scores: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best of each row by (score descending, key ascending)."""
    n = scores.shape[1]
    if n <= k:
        return scores, keys
    last = np.partition(scores, n - k, axis=1)[:, n - k]  # the best and all ties of the last, then by key
    out_s, out_k = np.empty((len(scores), k), np.int64), np.empty((len(scores), k), keys.dtype)
    for r in range(len(scores)):
        here = np.flatnonzero(scores[r] >= last[r])
        if len(here) > 4 * k:  # many ties of the last
            sure = np.flatnonzero(scores[r] > last[r])
            tied = here[scores[r, here] == last[r]]
            here = np.concatenate([sure, tied[np.argsort(keys[r, tied], kind="stable")[: k - len(sure)]]])
        here = here[np.lexsort((keys[r, here], -scores[r, here]))[:k]]
        out_s[r], out_k[r] = scores[r, here], keys[r, here]
    return out_s, out_k


class _Cell:
    def __init__(self, k: int, least: float | None):
        self.k, self.least = k, None if least is None else int(np.ceil(least * PLACES - 1e-9))
        self.asked: dict[int, list] = {}
        self.ready: dict[int, tuple] = {}
        self.tops: dict[int, tuple] = {}

    def ask(self, numbers: np.ndarray, rows: np.ndarray) -> None:
        q, ok = _unit(rows)
        self.asked.setdefault(rows.shape[1], []).append((numbers[ok], q))

    def meet(self, keys: np.ndarray, rows: np.ndarray) -> None:
        d = rows.shape[1]
        if d not in self.asked:
            return
        if d not in self.ready:
            self.ready[d] = tuple(np.concatenate(x) for x in zip(*self.asked[d], strict=True))
        numbers, q = self.ready[d]
        v, ok = _unit(rows)
        order = np.argsort(keys[ok], kind="stable")
        keys, v = keys[ok][order], v[order]
        step = max(self.k, TILE_SCORES // max(1, len(q)))
        for at in range(0, len(keys), step):
            scores = np.rint(q @ v[at : at + step].T * PLACES).astype(np.int64)
            some = np.broadcast_to(keys[at : at + step], scores.shape)
            if d in self.tops:
                scores, some = np.concatenate([self.tops[d][0], scores], 1), np.concatenate([self.tops[d][1], some], 1)
            self.tops[d] = kept_best(scores, some, self.k)

    def lists(self, name: str) -> Iterator[pa.RecordBatch]:
        for d, (scores, keys) in self.tops.items():
            keep = np.ones(scores.shape, bool) if self.least is None else scores >= self.least
            r, c = np.nonzero(keep)
            yield pa.RecordBatch.from_arrays([pa.array(self.ready[d][0][r]), pa.array(keys[r, c].tolist()), pa.array(scores[r, c])], names=["_q", name, "_s"])


def _run(name: str, k: int, least: float | None):
    def run(batches):
        cell, at_cell = None, None
        for b in batches:
            groups, cells, kinds, numbers = (b.column(c).to_numpy(zero_copy_only=False) for c in ("_g", "_cell", "_kind", "_q"))
            keys = np.array(b.column(name).to_pylist(), dtype=object) if pa.types.is_string(b.column(name).type) else b.column(name).to_numpy(zero_copy_only=False)
            vectors = b.column("_v")
            starts = vectors.offsets.to_numpy()
            flat, lengths = vectors.values.to_numpy(zero_copy_only=False), np.diff(starts)
            change = np.flatnonzero((np.diff(groups) != 0) | (np.diff(cells) != 0) | (np.diff(kinds) != 0) | (np.diff(lengths) != 0)) + 1
            for i, j in zip([0, *change], [*change, len(cells)], strict=True):
                if i == j:
                    continue
                if (groups[i], cells[i]) != at_cell:
                    if cell:
                        yield from cell.lists(name)
                    cell, at_cell = _Cell(k, least), (groups[i], cells[i])
                rows = flat[starts[i] : starts[j]].reshape(j - i, lengths[i])
                if kinds[i]:
                    cell.meet(keys[i:j], rows)
                else:
                    cell.ask(numbers[i:j], rows)
        if cell:
            yield from cell.lists(name)

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str, least: float | None = None, block: int | None = None, group: str | None = None) -> DataFrame:
    """query_id, key, score of up to ``k`` rows a question and shard: the candidates
    of a last window.  ``vectors``: (key, dense); ``queries``: (query_id, dense).

    With ``group``, a column of both, a question meets the vectors of its group only: each
    group has a grid of its own, whose blocks and shards go by the group's counts.
    """
    usable = F.col("dense").isNotNull() & (F.size("dense") > 0)
    named = [] if group is None else [group]
    asked = cut(queries.where(usable).select("query_id", "dense", *named, F.monotonically_increasing_id().alias("_q")))
    have = vectors.where(usable).select(key, F.col("dense").alias("_v"), *named)
    most, fewest, growth = F.lit(QUESTIONS_MOST), F.lit(QUESTIONS_LEAST), F.lit(GROWTH)
    count = lambda df, name: df.groupBy(*named).agg(F.count(F.lit(1)).alias(name))
    sizes = count(asked, "n").join(count(have, "m"), named) if named else count(asked, "n").join(count(have, "m"))  # one row without groups
    block = F.lit(block) if block else F.least(most, F.greatest(fewest, F.floor(growth * F.sqrt("n"))))
    shard = F.greatest(F.lit(SHARD_LEAST), F.floor(growth * F.sqrt("m")))
    over = lambda n, by: F.greatest(F.lit(1), F.ceil(F.col(n) / by)).cast("int")
    sizes = cut(sizes.select(*named, F.monotonically_increasing_id().alias("_g"), over("n", block).alias("_cols"), over("m", shard).alias("_rows")))
    grid = lambda df: df.join(sizes, named) if named else df.join(F.broadcast(sizes))
    kind = dict(have.dtypes)[key]
    spread = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
    q = grid(asked).select(F.lit("" if kind == "string" else 0).cast(kind).alias(key), F.col("dense").alias("_v"), "_q", "_g", "_cols", F.pmod(F.xxhash64("_q"), F.col("_cols")).alias("_col"), spread("_rows").alias("_row"), F.lit(0).alias("_kind"))
    v = grid(have.withColumn("_n", F.monotonically_increasing_id())).withColumn("_row", F.pmod("_n", F.col("_rows"))).select(key, "_v", F.lit(0).cast("long").alias("_q"), "_g", "_cols", spread("_cols").alias("_col"), "_row", F.lit(1).alias("_kind"))
    cells = q.unionByName(v).select("_g", (F.col("_row") * F.col("_cols") + F.col("_col")).cast("long").alias("_cell"), "_kind", "_q", key, "_v")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.repartition(parts, "_g", "_cell").sortWithinPartitions("_g", "_cell", "_kind", F.size("_v"))
    out = StructType([StructField("_q", LongType()), StructField(key, StringType() if kind == "string" else LongType()), StructField("_s", LongType())])
    found = dealt.mapInArrow(_run(key, k, least), out).join(asked.select("_q", "query_id"), "_q")
    return found.select("query_id", F.col(key).cast(kind).alias(key), F.round(F.col("_s") / PLACES, 6).alias("score"))
