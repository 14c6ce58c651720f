"""Uniform sharding with exact shard sizes through a communication matrix.

The input is seen as ``P`` blocks that exchange rows with ``S`` shards.  For a
uniformly random permutation of all rows, the number of rows that block ``b``
sends to shard ``j`` follows a multivariate hypergeometric law.  The operator

1. counts the blocks (one small aggregate),
2. draws the whole P x S matrix, row by row, from block and shard sizes, by exact
   conditional laws (see ``hypergeometric`` for the arithmetic),
3. permutes each block locally by a keyed hash and cuts it by its matrix row,
4. exchanges the rows, and permutes each shard again by a second hash.

Shard sizes differ by at most one row.  All row work is DataFrame functions;
the driver only sees one count a block.

Defined results
* null text: size 1, crc32 0; empty text: the same.
* repeated rows: each copy is a row of its own and gets its own slot; which of
  two identical rows gets which slot is immaterial.  Over ``HOT_ROWS`` copies of
  one row are spread like all others.
* null keys: hashed like any value.
* empty table: no rows.
* other columns, whatever their names, take no part; names that begin with
  ``_qs_`` are reserved for work columns.
"""

from __future__ import annotations

import math
import random
from decimal import Decimal, localcontext
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import blocks_for, discard, hot_keys, materialize, unsigned_crc32

#: Blocks hold this many rows until there are MOST_BLOCKS of them; then they
#: grow, so that the matrix on the driver stays small.
ROWS_PER_BLOCK, MOST_BLOCKS = 10_000, 4096
#: Rows that one window group ranks.
ROWS_PER_RANGE = 1024


#: Digits of the exact arithmetic, and the distance from a border of the
#: distribution below which a draw in doubles is repeated with it.
DIGITS, GUARD = 60, 1e-9
_BERNOULLI = [(1, 6), (-1, 30), (1, 42), (-1, 30), (5, 66), (-691, 2730), (7, 6), (-3617, 510), (43867, 798), (-174611, 330)]
_HALF_LOG_2PI = Decimal("0.918938533204672741780329736405617639861397473637783412817151540482765695927260")


@lru_cache(maxsize=100_000)
def _log_factorial(n: int) -> Decimal:
    """Natural logarithm of n!, to 45 decimal places at least."""
    with localcontext() as c:
        c.prec = DIGITS
        if n < 1000:
            return Decimal(math.factorial(n)).ln()
        x = Decimal(n)
        out = (x + Decimal("0.5")) * x.ln() - x + _HALF_LOG_2PI
        for k, (p, q) in enumerate(_BERNOULLI, 1):
            out += Decimal(p) / (Decimal(q) * (2 * k) * (2 * k - 1) * x ** (2 * k - 1))
        return out


def _probability(good: int, bad: int, draws: int, k: int) -> Decimal:
    with localcontext() as c:
        c.prec = DIGITS
        log = sum((_log_factorial(a) - _log_factorial(b) - _log_factorial(a - b) for a, b in ((good, k), (bad, draws - k))), Decimal(0))
        total = good + bad
        return (log - _log_factorial(total) + _log_factorial(draws) + _log_factorial(total - draws)).exp()


def _walk(u, p_mode, mode: int, lo: int, hi: int, good: int, bad: int, draws: int) -> tuple[int, float]:
    """Inversion outward from the mode: the value, and the least distance of ``u``
    from a border that it passed."""
    left, near = u - p_mode, 1.0
    near = min(near, abs(float(left)))
    up, down, p_up, p_down = mode, mode, p_mode, p_mode
    value = mode
    while left > 0 and (up < hi or down > lo):
        if up < hi:
            p_up = p_up * ((good - up) * (draws - up)) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left, value = left - p_up, up
            near = min(near, abs(float(left)))
            if left <= 0:
                break
        if down > lo:
            p_down = p_down * (down * (bad - draws + down)) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left, value = left - p_down, down
            near = min(near, abs(float(left)))
    return value, near


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """One draw by inversion outward from the mode.

    The walk visits about a standard deviation of values.  The probability of the
    mode comes from logarithms of 45 exact places, so nothing cancels however
    large the counts; the walk runs in doubles, and is repeated with 60 digits
    where the variate lies within ``GUARD`` of a border.  What remains is a total
    variation of less than 1e-30 from the exact law.
    """
    lo, hi = max(0, draws - bad), min(draws, good)
    if lo == hi:
        return lo
    mode = min(hi, max(lo, (draws + 1) * (good + 1) // (good + bad + 2)))
    bits = rng.getrandbits(160)
    p_mode = _probability(good, bad, draws, mode)
    value, near = _walk(bits / (1 << 160), float(p_mode), mode, lo, hi, good, bad, draws)
    if near < GUARD:
        with localcontext() as c:
            c.prec = DIGITS
            value, _ = _walk(Decimal(bits) / (1 << 160), p_mode, mode, lo, hi, good, bad, draws)
    return value


def communication_matrix(block_sizes: list[int], shard_sizes: list[int], seed: int) -> list[list[int]]:
    """Rows sum to ``block_sizes``, columns to ``shard_sizes``; drawn exactly."""
    rng = random.Random(seed)
    left = list(shard_sizes)
    matrix = []
    for size in block_sizes:
        row, draws, others = [], size, sum(left)
        for j, good in enumerate(left):
            others -= good
            k = draws if j == len(left) - 1 else hypergeometric(rng, good, others, draws)
            row.append(k)
            draws -= k
        left = [a - b for a, b in zip(left, row, strict=True)]
        matrix.append(row)
    return matrix


def ranked(df: DataFrame, group: str, key: str, ties: list[str], n_buckets: int, out: str) -> DataFrame:
    """Gapless rank from 0 of ``key`` within ``group``, without one task a group.

    Each group is cut into ranges of the hash key; bucket counts, summed up,
    give the offset of each range, and a window ranks inside it.
    """
    if n_buckets > 1:
        df = df.withColumn("_qs_bucket", F.shiftright(F.shiftrightunsigned(F.col(key), 33) * F.lit(n_buckets), 31).cast("int"))
    else:
        df = df.withColumn("_qs_bucket", F.lit(0))
    counts = df.groupBy(group, "_qs_bucket").agg(F.count(F.lit(1)).alias("_qs_n"))
    before = Window.partitionBy(group).orderBy("_qs_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "_qs_bucket", F.coalesce(F.sum("_qs_n").over(before), F.lit(0)).alias("_qs_offset"))
    inside = Window.partitionBy(group, "_qs_bucket").orderBy(F.shiftrightunsigned(F.col(key), 1), key, *ties)
    df = df.withColumn("_qs_rank", F.row_number().over(inside) - 1)
    return df.join(offsets, [group, "_qs_bucket"]).withColumn(out, (F.col("_qs_rank") + F.col("_qs_offset")).cast("long")).drop("_qs_rank", "_qs_offset", "_qs_bucket")


def numbered(keys: DataFrame, identity: list[str]) -> DataFrame:
    """``keys`` with ``_qs_copy``: 0, but for rows of which there are many alike,
    their number among these, so that they don't all fall into one place.

    Rows alike are interchangeable, so whichever gets a number, the result is the
    same.  They are numbered task by task, never in one.
    """
    named = keys.withColumn("_qs_name", F.xxhash64(F.lit("copies"), *identity))
    hot = hot_keys(named, "_qs_name", named.count())
    if not hot:
        return keys.withColumn("_qs_copy", F.lit(0).cast("long"))
    apart = F.col("_qs_name").isin(hot)
    rows = materialize(named.where(apart).withColumn("_qs_part", F.spark_partition_id()), "shard-copies")
    counts = rows.groupBy("_qs_name", "_qs_part").agg(F.count(F.lit(1)).alias("_qs_n"))  # a row a hot key and task
    before = Window.partitionBy("_qs_name").orderBy("_qs_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_qs_name", "_qs_part", F.coalesce(F.sum("_qs_n").over(before), F.lit(0)).alias("_qs_offset"))
    inside = Window.partitionBy("_qs_name", "_qs_part").orderBy(*identity)
    rows = rows.withColumn("_qs_at", F.row_number().over(inside) - 1).join(F.broadcast(offsets), ["_qs_name", "_qs_part"])
    rows = rows.withColumn("_qs_copy", (F.col("_qs_at") + F.col("_qs_offset")).cast("long"))
    rest = named.where(~apart).withColumn("_qs_copy", F.lit(0).cast("long"))
    return rest.select(*keys.columns, "_qs_copy").unionByName(rows.select(*keys.columns, "_qs_copy"))


def shard(keys: DataFrame, identity: list[str], n_shards: int = 16, seed: int = 7, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Assign every row of ``keys`` a ``shard`` and a ``slot`` in it.

    ``identity`` names the columns that seed the hashes; rows that agree in all
    of them are interchangeable.
    """
    rows = keyed = materialize(numbered(keys, identity), "shard-keys")
    identity = [*identity, "_qs_copy"]
    h = lambda s: F.xxhash64(F.lit(seed), F.lit(s), *identity)
    rows = rows.withColumn("_qs_local", h("local"))
    n = rows.count()
    n_blocks = min(MOST_BLOCKS, blocks_for(n, rows_per_block))
    rows = rows.withColumn("_qs_block", F.pmod(h("block"), F.lit(n_blocks)).cast("int"))
    sizes = {r[0]: r[1] for r in rows.groupBy("_qs_block").count().collect()}  # one row a block
    blocks = sorted(sizes)
    capacity = [n // n_shards + (j < n % n_shards) for j in range(n_shards)]
    matrix = communication_matrix([sizes[b] for b in blocks], capacity, seed)
    cuts = [",".join(str(sum(row[: j + 1])) for j in range(n_shards)) for row in matrix]
    literal = F.split(F.lit(";".join(f"{b}:{c}" for b, c in zip(blocks, cuts, strict=True))), ";")
    matrix_rows = (
        rows.sparkSession.range(1).select(F.explode(literal).alias("_qs_m")).where("_qs_m <> ''")
        .select(F.split("_qs_m", ":")[0].cast("int").alias("_qs_block"), F.split(F.split("_qs_m", ":")[1], ",").cast("array<bigint>").alias("_qs_cuts"))
    )
    ties = list(identity)
    sub = blocks_for(n // n_blocks, ROWS_PER_RANGE)
    rows = ranked(rows, "_qs_block", "_qs_local", ties, sub, "_qs_at")
    rows = rows.join(matrix_rows, "_qs_block")
    rows = rows.withColumn("shard", F.size(F.filter("_qs_cuts", lambda c: c <= F.col("_qs_at"))).cast("int"))
    rows = rows.withColumn("_qs_again", h("again")).drop("_qs_cuts", "_qs_at", "_qs_block", "_qs_local")
    rows = materialize(rows, "shard-exchange")
    discard(keyed)
    per_shard = blocks_for(n // n_shards, ROWS_PER_RANGE)
    return ranked(rows, "shard", "_qs_again", ties, per_shard, "slot").drop("_qs_again", "_qs_copy")


def shard_documents(docs: DataFrame, n_shards: int = 16, seed: int = 7) -> DataFrame:
    """Digest form: one row a document under the ``rows`` law."""
    keys = docs.select(
        "doc_id",
        (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"),
        unsigned_crc32(F.col("text")).alias("text_crc32"),
    )
    out = shard(keys, ["doc_id", "text_crc32", "size"], n_shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
