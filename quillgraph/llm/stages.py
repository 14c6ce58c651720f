"""The stages of the corpus pipeline, each over one operator.

Each takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns rows of
its columns; the last returns packed pieces.  Rows are told apart by their place
in the files, never by their id, so missing and repeated ids are ordinary rows.

Defined results
* null ids: rows like any other; a near-duplicate group without ids keeps one row.
* repeated rows: copies fall to one row in ``drop_near_duplicates``; elsewhere each
  counts.
* null and empty texts: not toxic; one group of near duplicates; nothing to redact;
  never taken by the mixture, as they have no words.
* other columns than those of ``documents`` are dropped.  Empty tables stay empty.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard, mixing, packing, pii, simhash, toxicity
from .common import discard, hot_keys, join_apart, materialize, row_keyed, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Row places (16 bytes each) up to which a list of dropped rows is broadcast.
BROADCAST_ROWS = 500_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go; the model is learned
    from the labelled documents of the corpus."""
    model = toxicity.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = toxicity.with_score(docs, model, COLUMNS, out="toxicity_score")
    return scored.where("toxicity_score < 0.5").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one of least id (rows
    without an id after all others; of rows that share it, the first).

    Two texts link at 3 bits of their SimHash or less, as in op2, or at a Jaccard
    similarity of 0.8 or more of their five-word shingles.
    """
    keyed = row_keyed(docs).select(*COLUMNS, "row")
    rows = materialize(jaccard.with_keys(keyed, ["row", "doc_id"]), "dedup-rows")
    more = jaccard.jaccard_links(rows, keyed)
    groups = materialize(simhash.grouped(rows.select("row", "doc_id", "fp"), more=more, root=True).select("row", "doc_id", "root"), "dedup-groups")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    first = groups.groupBy("root").agg(F.min(order)["row"].alias("first"))
    hot = hot_keys(groups, "root", groups.count())
    gone = materialize(join_apart(groups, first, "root", hot).where("row <> first").select("row"), "dedup-gone")
    discard(rows, more, groups)
    small = gone.count() <= BROADCAST_ROWS
    return keyed.join(F.broadcast(gone) if small else gone, "row", "left_anti").select(COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data becomes its kind, as in ``<email>``."""

    def run(batches):
        for b in batches:
            texts = [pii.redact(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, type=pa.string()), b.column("lang"), b.column("source"), b.column("n_chars")], names=COLUMNS)

    rows = docs.select(COLUMNS)
    return rows.mapInArrow(run, rows.schema).withColumn("n_chars", F.length("text").cast(rows.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it, in training order."""
    keyed = row_keyed(docs).select(*COLUMNS, "row")
    mixed = mixing.mix(keyed, keep=("row",))
    places = materialize(mixing.placed(mixed).select("row", "position"), "mix-places")
    discard(mixed)
    return mixing.range_sorted(keyed.join(places, "row")).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences of at most 1024 ids."""
    return packing.pack_documents(docs)
