"""Connected components of a link table.

Few links (``ONE_TASK`` or less, counted first, 16 bytes each) are joined by
union-find in one task.  More are settled by alternating large-star and
small-star rounds, which never gather a node's neighbours in one row.  Both give
the same exact result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hot_keys, join_apart, materialize

ONE_TASK = 500_000
RESULT = "node long, component long"


def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component = least node.

    Links of a node to itself and repeated links are harmless.  Empty links give
    an empty table.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = materialize(edges, "cc-start")
    if edges.count() <= one_task:
        out = materialize(edges.coalesce(1).mapInArrow(_union_find, RESULT), "cc-small")
        discard(edges)
        return out
    return star_rounds(edges)


def _union_find(batches):
    pairs = [np.stack([b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)]) for b in batches]
    if not pairs:
        return
    both = np.concatenate(pairs, axis=1)
    if not both.size:
        return
    nodes, at = np.unique(both, return_inverse=True)
    at = at.reshape(both.shape)
    root = list(range(len(nodes)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(at[0].tolist(), at[1].tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:  # the smaller node stays the root
            root[max(a, b)] = min(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[[find(x) for x in range(len(nodes))]])], names=["node", "component"])


def star_rounds(edges: DataFrame) -> DataFrame:
    """Alternating stars over (u > v) edges.

    Each round is joins on node keys, hubs apart by broadcast, and the state is written to the shared folder each round, the one before it
    deleted.  Edges shrink towards stars until a round changes none; the rounds
    grow with the logarithm of the graph's diameter, and each that changes
    something links a node to a lesser one, so they end.
    """
    mark = _mark(edges)
    while True:
        # large star: every larger neighbour of u links to u's least neighbour
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        hubs = hot_keys(both, "u", 2 * mark[0])
        large = join_apart(both.where("v > u"), least, "u", hubs).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours link to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_apart(large, least, "u", hubs).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        before, edges = edges, materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "cc-round")
        discard(before)
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))


def _mark(edges: DataFrame) -> tuple:
    hashes = (F.sum(F.xxhash64(*c).cast("decimal(38,0)")) for c in (("u", "v"), ("v", "u")))
    return tuple(edges.agg(F.count(F.lit(1)), *hashes).first())
