"""SimHash near-duplicate groups through the generalised pigeonhole principle.

Fingerprints: 64 bits over 3-word shingles, a bit set where over half of the
shingle hashes (XXH64, seed 42) have it.  Two texts link at a Hamming distance
of ``tau`` (3) or less, and a component is everything reachable by links.

Finding the links
-----------------
* Equal fingerprints are collapsed first, so groups of copies cost nothing more.
* The 64 bits are cut into ``m`` parts.  Bits that agree with one another (by
  their correlation over all fingerprints) share a part, which leaves the other
  parts more selective.
* Generalised pigeonhole: thresholds ``t_i >= -1`` whose sum is ``tau - m + 1``
  guarantee that two fingerprints within ``tau`` differ by at most ``t_i`` bits
  in some part ``i``.  Every fingerprint gets its own thresholds by dynamic
  programming over its estimated candidate counts: the exact size of its own
  bucket in each part, and the mean size of neighbouring buckets.
* ``m`` itself follows from the same cost model and the number of fingerprints.
* Probes meet the bucket index in an equi-join; pairs are verified by popcount.

No bucket is cut short.  A bucket of over ``DENSE_BUCKET`` fingerprints isn't
joined pair by pair.  All that probe it or lie in it take this exact way, whose
work is linear in their number: each fingerprint names the 65 words within one
bit.  All that name one word are within two bits of each other and link to the
least of them.  Fingerprints that then still lie apart from the largest
component of a dense bucket also name the 2016 words at two bits, and link to
anyone who has that word within one bit, thus within three.

Defined results
* null, empty and blank texts: fingerprint zero, which links like any other.
* one or two words: the whole sequence is the single shingle.
* repeated rows: each is returned; ids that repeat keep their own fingerprints.
* null doc_id: returned, takes no part in the choice of a component's least id
  unless all ids are null.
* empty table: no rows.  Other columns take no part.
"""

from __future__ import annotations

from itertools import combinations, product
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, discard, give_back, hot_keys, join_apart, materialize
from .components import components

TAU = 3
DENSE_BUCKET = 128
PROBE_COST, VERIFY_COST = 2.0, 1.0
SEED = 42


# --- fingerprints ---------------------------------------------------------


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of one whole text."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII space only
    n = len(words)
    if not n:
        return 0
    shingles = [b" ".join(words)] if n < 3 else [b" ".join(x) for x in zip(words, words[1:], words[2:], strict=False)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype=np.uint64, count=len(shingles))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and ``fp`` (the fingerprint as a signed long)."""
    keep = list(keep if keep is not None else ["doc_id"])
    rows = docs.select(*keep, F.col(text).alias("_qs_text"))
    schema = rows.select(*keep, F.lit(0).cast("long").alias("fp")).schema

    def run(batches):
        for b in batches:
            texts = b.column("_qs_text").to_pylist()
            fps = np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(fps, type=pa.int64())], names=[*keep, "fp"])
        give_back()

    return rows.mapInArrow(run, schema)


# --- parts and thresholds -------------------------------------------------


def bit_correlation(fps: DataFrame) -> np.ndarray:
    """Absolute correlation of the 64 bits over all fingerprints.

    Each partition adds up its own counts; 2081 sums reach the driver.
    """

    def run(batches):
        both, n = np.zeros((64, 64)), 0
        for b in batches:
            x = np.unpackbits(b.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += x.T @ x
            n += len(x)
        if n:
            i, j = np.triu_indices(64)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(i, 64).astype(np.int32)), pa.array(np.append(j, 64).astype(np.int32)), pa.array(np.append(both[i, j], n).astype(np.int64))], names=["i", "j", "n"])

    sums = fps.select("fp").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    table = {(r.i, r.j): r.n for r in sums}
    n = max(1, table.get((64, 64), 1))
    p = np.array([table.get((i, i), 0) / n for i in range(64)])
    out = np.zeros((64, 64))
    for i, j in combinations(range(64), 2):
        sd = (p[i] * (1 - p[i]) * p[j] * (1 - p[j])) ** 0.5
        out[i, j] = out[j, i] = abs(table.get((i, j), 0) / n - p[i] * p[j]) / sd if sd > 1e-9 else 1.0
    return out


def group_bits(correlation: np.ndarray, m: int) -> list[list[int]]:
    """``m`` parts of near-equal width; bits that agree most share a part."""
    left, parts = set(range(64)), []
    for k in range(m):
        width = 64 // m + (k < 64 % m)
        seed = max(left, key=lambda b: (sum(correlation[b, c] for c in left), -b))
        part = [seed]
        left.remove(seed)
        while len(part) < width:
            nxt = max(left, key=lambda b: (sum(correlation[b, c] for c in part), -b))
            part.append(nxt)
            left.remove(nxt)
        parts.append(sorted(part))
    return parts


def ball(width: int, radius: int) -> int:
    return sum(comb(width, r) for r in range(radius + 1)) if radius >= 0 else 0


def threshold_plans(m: int, tau: int) -> list[tuple[int, ...]]:
    return [t for t in product(range(-1, tau + 1), repeat=m) if sum(t) == tau - m + 1]


def choose_parts(n: int, tau: int) -> int:
    """Number of parts with the least expected cost a fingerprint."""

    def cost(m: int) -> float:
        widths = [64 // m + (k < 64 % m) for k in range(m)]
        return min(sum(ball(w, t) * (PROBE_COST + VERIFY_COST * n / 2**w) for w, t in zip(widths, p, strict=True)) for p in threshold_plans(m, tau))

    return min(range(2, tau + 3), key=cost)


def allocate(sizes: np.ndarray, widths: list[int], n: int, tau: int) -> np.ndarray:
    """Thresholds for each row of ``sizes`` (rows x parts: own bucket sizes).

    Dynamic programming over parts and the sum spent so far, for all rows at once.
    """
    rows, m = sizes.shape
    goal = tau - m + 1
    best, picks = {0: np.zeros(rows)}, []
    for i, w in enumerate(widths):
        costs = {-1: np.zeros(rows)}
        for e in range(tau + 1):
            near = ball(w, e) - 1
            costs[e] = VERIFY_COST * (sizes[:, i] + near * (n / 2**w)) + PROBE_COST * (near + 1)
        nxt: dict[int, np.ndarray] = {}
        pick: dict[int, np.ndarray] = {}
        for spent, so_far in best.items():
            for e, c in costs.items():
                s = spent + e
                if not goal - (m - 1 - i) * tau <= s <= goal + (m - 1 - i):
                    continue
                total = so_far + c
                if s not in nxt:
                    nxt[s], pick[s] = total, np.full(rows, e, dtype=np.int8)
                else:
                    less = total < nxt[s]
                    nxt[s] = np.where(less, total, nxt[s])
                    pick[s] = np.where(less, e, pick[s]).astype(np.int8)
        best = nxt
        picks.append(pick)
    out = np.zeros((rows, m), dtype=np.int8)
    at = np.full(rows, goal)
    for i in range(m - 1, -1, -1):
        for s in np.unique(at):
            here = at == s
            out[here, i] = picks[i][int(s)][here]
        at = at - out[:, i]
    return out


def masks(width: int, radius: int, exactly: bool = False) -> np.ndarray:
    """XOR masks of ``width`` bits with up to (or exactly) ``radius`` set."""
    picks = [c for r in range(radius if exactly else 0, radius + 1) for c in combinations(range(width), r)]
    return np.array([sum(1 << b for b in c) for c in picks], dtype=np.uint64)


def part_values(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), dtype=np.uint64)
    for k, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


PART_SHIFT = np.uint64(50)  # a part has 32 bits at most; its number lies above


def _unsigned(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


# --- links ----------------------------------------------------------------


def find_links(fps: DataFrame, tau: int = TAU, dense_bucket: int = DENSE_BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fps`` (column fp).

    Every pair within ``tau`` is linked directly or joined by a path of links.
    """
    n = fps.count()
    parts = group_bits(bit_correlation(fps), choose_parts(n, tau))
    m, widths = len(parts), [len(p) for p in parts]

    def index_rows(batches):
        for b in batches:
            x = _unsigned(b.column(0))
            keys = np.concatenate([part_values(x, p) | (np.uint64(i) << PART_SHIFT) for i, p in enumerate(parts)])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.repeat(np.arange(m, dtype=np.int32), len(x))), pa.array(np.tile(x.view(np.int64), m))], names=["key", "part", "fp"])

    index = materialize(fps.select("fp").mapInArrow(index_rows, "key long, part int, fp long"), "gph-index")
    counts = materialize(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "gph-counts")
    hot = [r.key for r in counts.where(F.col("n") > max(HOT_ROWS, n * m // 1000)).collect()]  # a thousand at most
    own = join_apart(index, counts, "key", hot).groupBy("fp").agg(*(F.max(F.when(F.col("part") == i, F.col("n"))).alias(f"n{i}") for i in range(m)))

    def probe_rows(batches):
        for b in batches:
            x = _unsigned(b.column(0))
            if not len(x):
                continue
            sizes = np.stack([b.column(1 + i).to_numpy(zero_copy_only=False) for i in range(m)], axis=1).astype(np.float64)
            plan = allocate(sizes, widths, n, tau)
            for i, p in enumerate(parts):
                values = part_values(x, p)
                for e in range(tau + 1):
                    here = plan[:, i] == e
                    if not here.any():
                        continue
                    flips = masks(widths[i], e)
                    step = max(1, 500_000 // len(flips))
                    vs, xs = values[here], x[here]
                    for at in range(0, len(vs), step):
                        keys = (vs[at : at + step, None] ^ flips[None, :]) | (np.uint64(i) << PART_SHIFT)
                        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(xs[at : at + step], len(flips)).view(np.int64))], names=["key", "fp"])

    probes = own.mapInArrow(probe_rows, "key long, fp long")
    # the planner takes what mapInArrow returns for as small as what it reads, so
    # joins of many words or probes say that they merge
    live = materialize(probes.hint("merge").join(counts, "key"), "gph-probes")
    there = index.select("key", F.col("fp").alias("other"))
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("other")))
    cold = live.where(F.col("n") <= dense_bucket).select(F.col("key").alias("k"), "fp")
    links = cold.join(there, (F.col("k") == F.col("key")) & (F.col("fp") != F.col("other")) & (distance <= tau))
    links = materialize(links.select(F.greatest("fp", "other").alias("a"), F.least("fp", "other").alias("b")).distinct(), "gph-links")
    hot = live.where(F.col("n") > dense_bucket)
    if not hot.isEmpty():
        hot_keys = hot.select("key").distinct()
        members = hot.select("key", "fp").union(index.join(hot_keys, "key", "left_semi").select("key", "fp")).distinct()
        members = materialize(members, "gph-dense")
        first, second = dense_links(members, links, tau)
        every = materialize(links.union(first).union(second), "gph-all")
        discard(members, links, first, second)
        links = every
    discard(index, counts, live)
    return links


def dense_links(members: DataFrame, links: DataFrame, tau: int) -> tuple[DataFrame, DataFrame]:
    """Links among the fingerprints of dense buckets (key, fp), without pairs."""
    if tau != 3:
        raise ValueError("the exact way for dense buckets is built for tau = 3")

    def words_at(radius: int, exactly: bool):
        flips = masks(64, radius, exactly)

        def run(batches):
            for b in batches:
                x = _unsigned(b.column(0))
                step = max(1, 200_000 // len(flips))
                for at in range(0, len(x), step):
                    y = x[at : at + step]
                    yield pa.RecordBatch.from_arrays([pa.array((y[:, None] ^ flips[None, :]).ravel().view(np.int64)), pa.array(np.repeat(y, len(flips)).view(np.int64))], names=["word", "fp"])

        return run

    fps = members.select("fp").distinct()
    near = materialize(fps.mapInArrow(words_at(1, False), "word long, fp long"), "gph-near")
    anchors = materialize(near.groupBy("word").agg(F.min("fp").alias("anchor")), "gph-anchors")
    first = near.join(anchors, "word").where("fp <> anchor").select(F.col("fp").alias("a"), F.col("anchor").alias("b")).distinct()
    first = materialize(first, "gph-first")
    label = components(links.union(first))
    placed = members.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    placed = materialize(placed, "gph-placed")
    sizes = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("largest"))
    # a dense bucket may hold most of the fingerprints
    apart = join_apart(placed, largest, "key", hot_keys(placed, "key", placed.count())).where("component <> largest").select("fp").distinct()
    second = apart.mapInArrow(words_at(2, True), "word long, fp long").hint("merge").join(anchors, "word").where("fp <> anchor")
    second = materialize(second.select(F.col("fp").alias("a"), F.col("anchor").alias("b")).distinct(), "gph-second")
    discard(near, anchors, label, placed)
    return first, second


def near_groups(docs: DataFrame, tau: int = TAU, dense_bucket: int = DENSE_BUCKET, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (doc_id among them), ``fp`` and ``component_id``."""
    keep = list(keep if keep is not None else ["doc_id"])
    return grouped(materialize(with_fingerprints(docs, text, keep), "simhash"), tau, dense_bucket)


def grouped(rows: DataFrame, tau: int = TAU, dense_bucket: int = DENSE_BUCKET, more: DataFrame | None = None, root: bool = False) -> DataFrame:
    """``rows`` (doc_id and fp among them) with ``component_id``; ``more`` are
    further links (a, b) between their fingerprints.  ``root`` also returns the
    component's least fingerprint, which names it where all ids are null."""
    reps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "simhash-reps")
    links = find_links(reps.select("fp"), tau, dense_bucket)
    label = components(links if more is None else links.union(more))
    node = reps.join(label, reps.fp == label.node, "left").select("fp", "rep", "n", F.coalesce("component", "fp").alias("root"))
    node = materialize(node, "simhash-roots")
    # one component may hold most fingerprints: partial sums, then a join with hot ones apart
    least = node.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = join_apart(node, least, "root", hot_keys(node, "root", node.count()))
    named = materialize(named.select("fp", "component_id", "n", *(["root"] if root else [])), "simhash-named")
    discard(reps, links, label, node)
    total = rows.count()
    hot = [r.fp for r in named.where(F.col("n") > max(HOT_ROWS, total // 1000)).collect()]  # a thousand at most
    return join_apart(rows, named.drop("n"), "fp", hot)


def dedup_documents(docs: DataFrame) -> DataFrame:
    """Digest form: doc_id, fingerprint (hex), component_id."""
    return near_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
