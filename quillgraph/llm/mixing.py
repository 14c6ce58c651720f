"""Mixing sources to target weights along a time-varying curriculum.

Every source has a share of the whole and a weight schedule over training time
``t`` in [0, 1], piecewise linear between knots.  Its integral is the source's
cumulative token demand.  The documents of a source, in a keyed random order and
repeated as often as its target asks, fill that demand; inverting it at a
document's first token gives the time, and the sum of all demands at that time
the training position.  A range sort by position gives the training order.

Targets: sources in code-point order, null last, weigh 5, 2, 1, repeating, and
share the corpus's total size.  A source never exceeds ``cap`` times its own
size; what is over goes to the others by weight until none is above.  The fixed
point is a water level: ``min(cap * size, level * weight)``.

A source's words are taken in whole documents: all of them ``k`` times, and one
time more those whose middle lies within the remaining fraction.  So a source
misses its target by half a document at most, and no document is taken over
``cap`` times.

Prefix sums never put a source in one task: a source is cut into ranges of the
hash order and these into spans; span sums are added up, then range sums within a
span, and windows run within ranges.  Sources are ranked within ranges of their
names, and the water level is found by resharing rounds of plain sums.

Defined results
* null text: size 0, taken 0.  Null source: a source of its own, the last.
* null ids: ordered by their text.
* repeated rows: each row counts and is taken on its own; ties of the random
  order between identical rows are immaterial to the totals.
* sources without words: target 0.  Empty table: no rows.
* other columns are kept; names that begin with ``_qm_`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import blocks_for, discard, materialize, words

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"
#: Schedules by rank of source, repeating: (time, weight) knots.  Heavy sources
#: lead early, light ones gain towards the end.
SCHEDULES = (((0.0, 1.25), (0.5, 1.0), (1.0, 0.75)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
ROWS_PER_RANGE = 1024
#: Source tables of at most this many rows are broadcast.
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """Adds rank, weight and target to one row a source (source, source_size)."""
    n = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("source").asc_nulls_last()
    dealt = materialize(sizes.repartitionByRange(n, order).withColumn("_qm_part", F.spark_partition_id()), "mix-ranks")
    counts = dealt.groupBy("_qm_part").agg(F.count(F.lit(1)).alias("_qm_n"))  # a row a task
    before = Window.orderBy("_qm_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_qm_part", F.coalesce(F.sum("_qm_n").over(before), F.lit(0)).alias("_qm_before"))
    ranked = dealt.withColumn("_qm_at", F.row_number().over(Window.partitionBy("_qm_part").orderBy(order)) - 1).join(F.broadcast(counts), "_qm_part")
    ranked = ranked.withColumn("rank", (F.col("_qm_at") + F.col("_qm_before")).cast("long")).drop("_qm_part", "_qm_at", "_qm_before")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    ranked = materialize(ranked.withColumn("weight", weight).withColumn("_qm_cap", (F.lit(cap) * F.col("source_size")).cast("double")), "mix-weights")
    level = water_level(ranked)
    discard(dealt)
    return ranked.withColumn("target", F.least(F.col("_qm_cap"), F.lit(level) * F.col("weight"))).drop("_qm_cap")


def water_level(ranked: DataFrame) -> float:
    """Size for each unit of weight, after what exceeds the caps is reshared.

    Every round fixes the sources that the level fills and shares the rest among
    the others.  The level only rises, so the rounds end; they are few, as each
    one fixes a source at least.
    """
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = -1.0
    while True:
        full = F.col("_qm_cap") < F.lit(level) * F.col("weight")
        capped, weight = ranked.agg(F.sum(F.when(full, F.col("_qm_cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not weight:
            return level
        now = (total - (capped or 0.0)) / weight
        if now <= level:
            return level
        level = now


def _segments(knots) -> list[tuple[float, float, float, float, float]]:
    """(t0, t1, w0, w1, demand before), demand in parts of the whole."""
    whole = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))
    out, so_far = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        out.append((t0, t1, w0 / whole, w1 / whole, so_far))
        so_far += (t1 - t0) * (w0 + w1) / 2 / whole
    return out


def demand_at(t: Column, knots) -> Column:
    """Part of a source's whole demand before time ``t``."""
    out = F.lit(1.0)
    for t0, t1, w0, w1, so_far in reversed(_segments(knots)):
        x = t - t0
        out = F.when(t < t1, so_far + w0 * x + (w1 - w0) / (t1 - t0) * x * x / 2).otherwise(out)
    return out


def time_of(part: Column, knots) -> Column:
    """Inverse of ``demand_at``."""
    out = F.lit(1.0)
    for t0, t1, w0, w1, so_far in reversed(_segments(knots)):
        slope, y = (w1 - w0) / (t1 - t0), part - so_far
        x = y / w0 if abs(slope) < 1e-12 else (F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + 2 * slope * y)) - w0) / slope
        end = so_far + (t1 - t0) * (w0 + w1) / 2
        out = F.when(part < end, t0 + x).otherwise(out)
    return out


def by_schedule(rank: Column, schedules, f) -> Column:
    out = f(schedules[0])
    for k in range(1, len(schedules)):
        out = F.when(F.pmod(rank, F.lit(len(schedules))) == k, f(schedules[k])).otherwise(out)
    return out


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, cap: int = CAP, schedules=SCHEDULES, seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: ``keep``, size, source_size, target, taken, epochs, begin.

    ``begin`` is the first token's place in the source's stream of one epoch;
    ``placed`` turns it into training positions.
    """
    name = F.coalesce(F.col(key).cast("string"), F.md5(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")))
    rows = docs.select(*keep, F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.md5(F.concat(name, F.lit(f"|{seed}"))).alias("_qm_h"))
    rows = sized = materialize(rows, "mix-sizes")
    n = rows.count()
    per_source = materialize(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    targets = materialize(source_targets(per_source, weights, cap), "mix-targets")
    small = targets.count() <= BROADCAST_SOURCES
    t = F.broadcast(targets) if small else targets
    rows = rows.alias("r").join(t.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select("r.*", "rank", "source_size", "target")
    ranges = blocks_for(n, ROWS_PER_RANGE)
    rows = rows.withColumn("_qm_range", F.shiftright(F.conv(F.substring("_qm_h", 1, 8), 16, 10).cast("long") * F.lit(ranges), 32))
    rows = rows.withColumn("_qm_span", F.floor(F.col("_qm_range") / ROWS_PER_RANGE).cast("long"))
    sums = rows.groupBy("rank", "_qm_span", "_qm_range").agg(F.sum("size").alias("_qm_sum"))
    spans = sums.groupBy("rank", "_qm_span").agg(F.sum("_qm_sum").alias("_qm_sum"))
    to_here = lambda w: F.coalesce(F.sum("_qm_sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("rank", "_qm_span", to_here(Window.partitionBy("rank").orderBy("_qm_span")).alias("_qm_before"))
    offsets = sums.withColumn("_qm_offset", to_here(Window.partitionBy("rank", "_qm_span").orderBy("_qm_range"))).join(spans, ["rank", "_qm_span"])
    offsets = offsets.select("rank", "_qm_range", (F.col("_qm_offset") + F.col("_qm_before")).alias("_qm_offset"))
    inside = Window.partitionBy("rank", "_qm_range").orderBy("_qm_h", "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_qm_inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(offsets, ["rank", "_qm_range"]).withColumn("begin", F.col("_qm_inner") + F.col("_qm_offset"))
    ratio = F.col("target") / F.greatest(F.col("source_size"), F.lit(1))
    whole = F.least(F.floor(ratio), F.lit(cap)).cast("long")
    over = F.col("target") - whole * F.col("source_size")
    more = (F.col("begin") + F.col("size") / 2 < over) & (whole < cap)
    epochs = F.when(F.col("size") == 0, 0).otherwise(whole + more.cast("long"))
    rows = rows.withColumn("epochs", epochs.cast("int")).withColumn("taken", (F.col("size") * F.col("epochs")).cast("long"))
    out = materialize(rows.select(*keep, "doc_id", "source", "rank", "size", "source_size", "target", "taken", "epochs", "begin"), "mixed")
    discard(sized, per_source, targets)
    return out


def placed(mixed: DataFrame, schedules=SCHEDULES) -> DataFrame:
    """One row for every time a document is taken, with its training position."""
    rows = mixed.where("epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    part = F.least(F.lit(1.0), (F.col("begin") + F.col("epoch") * F.col("source_size")) / F.greatest(F.col("target"), F.lit(1.0)))
    rows = rows.withColumn("time", by_schedule(F.col("rank"), schedules, lambda k: time_of(part, k)))
    shares = mixed.groupBy("rank").agg(F.max("target").alias("target"))
    kinds = shares.groupBy(F.pmod("rank", F.lit(len(schedules))).alias("kind")).agg(F.sum("target").alias("demand"))
    demand = {r.kind: r.demand for r in kinds.collect()}  # one row a schedule
    total = F.lit(0.0)
    for k, knots in enumerate(schedules):
        total = total + F.lit(float(demand.get(k, 0.0))) * demand_at(F.col("time"), knots)
    return rows.withColumn("position", total)


def range_sorted(rows: DataFrame) -> DataFrame:
    """Rows in the order of their position, over ranges of it; rows without one, and
    rows of one position, are spread over ranges by a salt."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = rows.withColumn("_qm_salt", F.xxhash64(F.monotonically_increasing_id()))
    return salted.repartitionByRange(n, "position", "_qm_salt").sortWithinPartitions("position").drop("_qm_salt")


def mix_documents(docs: DataFrame) -> DataFrame:
    """Digest form: one row a document in training order, with the position of its
    first use; what the mixture leaves out comes first, without one."""
    mixed = mix(docs)
    first = placed(mixed.withColumn("epochs", F.least("epochs", F.lit(1)))).select("doc_id", "size", "source_size", "target", "taken", F.round("position", 3).alias("position"))
    never = mixed.where("epochs = 0").select("doc_id", "size", "source_size", "target", "taken", F.lit(None).cast("double").alias("position"))
    return range_sorted(first.union(never))


# --- the digest in SQL ----------------------------------------------------


def _case(pairs: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in pairs) + f" ELSE {default} END"


def _sql_demand(t: str, knots) -> str:
    return _case([(f"{t} < {t1!r}", f"{so_far!r} + {w0!r} * ({t} - {t0!r}) + {(w1 - w0) / (t1 - t0)!r} * ({t} - {t0!r}) * ({t} - {t0!r}) / 2") for t0, t1, w0, w1, so_far in _segments(knots)], "1.0")


def _sql_time(part: str, knots) -> str:
    pairs = []
    for t0, t1, w0, w1, so_far in _segments(knots):
        slope, y = (w1 - w0) / (t1 - t0), f"({part} - {so_far!r})"
        x = f"{y} / {w0!r}" if abs(slope) < 1e-12 else f"(sqrt(greatest(0.0, {w0 * w0!r} + {2 * slope!r} * {y})) - {w0!r}) / {slope!r}"
        pairs.append((f"{part} < {so_far + (t1 - t0) * (w0 + w1) / 2!r}", f"{t0!r} + {x}"))
    return _case(pairs, "1.0")


def _sql() -> str:
    kind = f"(rank % {len(SCHEDULES)})"
    time = _case([(f"{kind} = {k}", _sql_time("part", s)) for k, s in enumerate(SCHEDULES)], "1.0")
    total = " + ".join(f"coalesce((SELECT sum(target) FROM t WHERE {kind} = {k}), 0.0) * ({_sql_demand('time', s)})" for k, s in enumerate(SCHEDULES))
    weight = _case([(f"rank % {len(WEIGHTS)} = {k}", f"{float(w)!r}") for k, w in enumerate(WEIGHTS)], "0.0")
    return f"""
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[ \\t-\\r]+'), lambda w: w <> '')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) || '|{SEED}') AS h FROM documents),
 z AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
 k AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM z),
 w AS (SELECT *, CAST({weight} AS DOUBLE) AS weight, CAST({CAP} * source_size AS DOUBLE) AS c FROM k),
 l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(c) OVER b, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0)) AS lev
   FROM w WINDOW b AS (ORDER BY c / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 v AS (SELECT lev FROM l WHERE c / weight >= lev ORDER BY c / weight, rank LIMIT 1),
 t AS (SELECT source, source_size, rank, coalesce(least(c, (SELECT lev FROM v) * weight), c) AS target FROM l),
 x AS (SELECT d.*, source_size, rank, target, CAST(coalesce(sum(size) OVER (PARTITION BY rank ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS beg
   FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
 y AS (SELECT *, least(floor(target / greatest(source_size, 1)), {CAP}) AS whole FROM x),
 e AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE CAST(whole AS BIGINT) + CASE WHEN beg + size / 2.0::DOUBLE < target - whole * source_size AND whole < {CAP} THEN 1 ELSE 0 END END AS epochs FROM y),
 p AS (SELECT *, least(1.0, beg / greatest(target, 1.0)) AS part FROM e),
 q AS (SELECT *, {time} AS time FROM p)
SELECT doc_id, size, source_size, target, CAST(size * epochs AS BIGINT) AS taken, CASE WHEN epochs > 0 THEN round({total}, 3) END AS position FROM q
"""


SQL = _sql()
