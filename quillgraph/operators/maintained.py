"""Relations and degrees as stored tables, moved by signed changes.

A relation's weight and number of evidence rows are sums, so evidence that comes or goes
moves them by a signed delta; a degree is a count of mentions and of relation ends, so it
moves by what comes and goes, too.  A description can't be taken back out of a maximum,
but it needn't be: a relation that loses evidence loses its description, and evidence that
comes later competes with the one that is kept, longest first, then earliest.

Every function takes what is stored for the touched keys and the change, and gives the
new rows of these keys alone; a keyed merge writes only their buckets.  Applying changes
in any split gives what ``build.relations`` and a recount give for the final evidence.

Defined results: a relation without evidence left has no row, nor has an entity without
mentions and relations.  A relation of an entity with itself counts as two ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["src_id", "predicate", "dst_id"]


def evidence_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed rows: KEY, strength, n, description, seq of evidence that came or went."""
    whole = [*KEY, "chunk_id"]
    rows = lambda df, sign: df.select(*KEY, (F.col("strength") * sign).cast("long").alias("strength"), F.lit(sign).cast("long").alias("n"), "description", "seq")
    came = after.join(before.select(*whole), whole, "left_anti")
    went = before.join(after.select(*whole), whole, "left_anti")
    return rows(came, 1).unionByName(rows(went, -1))


def moved_relations(stored: DataFrame, change: DataFrame) -> DataFrame:
    """KEY, weight, n_evidence, description, seq, was: new rows of the change's keys, with
    n_evidence 0 where nothing is left; ``was`` is the number before."""
    delta = change.groupBy(*KEY).agg(F.sum("strength").alias("ds"), F.sum("n").alias("dn"), F.bool_or(F.col("n") < 0).alias("lost"), F.max_by(F.struct("description", "seq"), F.when(F.col("n") > 0, F.struct(F.length("description"), -F.col("seq")))).alias("new"))
    both = delta.join(stored.select(*KEY, "weight", "n_evidence", F.struct("description", "seq").alias("old")), KEY, "left")
    kept = F.when(F.col("old").isNotNull(), F.when(F.col("lost"), F.struct(F.lit("").alias("description"), F.col("old.seq").alias("seq"))).otherwise(F.col("old")))
    rank = lambda d: F.struct(F.length(d["description"]), -d["seq"])
    best = F.when(kept.isNull() | (rank(F.col("new")) > rank(kept)), F.col("new")).otherwise(kept)
    out = both.withColumn("best", best)
    return out.select(*KEY, (F.coalesce("weight", F.lit(0.0)) + F.col("ds")).cast("double").alias("weight"), (F.coalesce("n_evidence", F.lit(0)) + F.col("dn")).cast("long").alias("n_evidence"), F.coalesce("best.description", F.lit("")).alias("description"), F.col("best.seq").alias("seq"), F.coalesce("n_evidence", F.lit(0)).alias("was"))


def degree_change(moved: DataFrame, came: DataFrame, went: DataFrame) -> DataFrame:
    """(entity_id, d): from relations that appear or vanish and mentions (entity_id) that
    come or go."""
    appear = F.when((F.col("was") == 0) & (F.col("n_evidence") > 0), 1).when((F.col("was") > 0) & (F.col("n_evidence") == 0), -1).otherwise(0)
    ends = moved.select("src_id", "dst_id", appear.alias("d")).where("d <> 0")
    rows = [ends.select(F.col(c).alias("entity_id"), "d") for c in ("src_id", "dst_id")] + [m.select("entity_id", F.lit(s).alias("d")) for m, s in ((came, 1), (went, -1))]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.groupBy("entity_id").agg(F.sum("d").cast("long").alias("d")).where("d <> 0")


def moved_degrees(stored: DataFrame, change: DataFrame) -> DataFrame:
    """(entity_id, degree) of the change's entities; 0 where nothing is left."""
    return change.join(stored, "entity_id", "left").select("entity_id", (F.coalesce("degree", F.lit(0)) + F.col("d")).cast("long").alias("degree"))


def rebuilt(evidence: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relations, degrees) from scratch."""
    best = F.max_by(F.struct("description", "seq"), F.struct(F.length("description"), -F.col("seq"))).alias("b")
    r = evidence.groupBy(*KEY).agg(F.sum("strength").cast("double").alias("weight"), F.count(F.lit(1)).alias("n_evidence"), best)
    r = r.select(*KEY, "weight", "n_evidence", F.col("b.description").alias("description"), F.col("b.seq").alias("seq"))
    ends = r.select(F.col("src_id").alias("entity_id")).unionByName(r.select(F.col("dst_id").alias("entity_id"))).unionByName(mentions.select("entity_id"))
    return r, ends.groupBy("entity_id").agg(F.count(F.lit(1)).alias("degree"))


def changes(read, evidence: tuple[DataFrame, DataFrame], came: DataFrame, went: DataFrame, cut) -> dict[str, tuple[DataFrame, DataFrame]]:
    """The keyed merges of both tables; ``read`` gives at least the rows of the keys that
    it gets, ``evidence`` is (before, after), ``came`` and ``went`` are mentions."""
    change = cut(evidence_change(*evidence))
    moved = cut(moved_relations(read("relations", change.select(*KEY).distinct()), change))
    ends = cut(degree_change(moved, came, went))
    degrees = cut(moved_degrees(read("degrees", ends.select("entity_id")), ends))
    return {
        "relations": (moved.select(*KEY), moved.where("n_evidence > 0").select(*KEY, "weight", "n_evidence", "description", "seq")),
        "degrees": (degrees.select("entity_id"), degrees.where("degree > 0")),
    }
