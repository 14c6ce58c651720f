"""A corpus pipeline: toxicity, near duplicates, PII, mixture, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and returns a DataFrame that is written as Parquet and reread as the next docs.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import stages
from quillgraph.llm.common import materialize, table

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", stages.drop_toxic),
    ("simhash", stages.drop_near_duplicates),
    ("pii", stages.redact_personal_data),
    ("mixing", stages.mix_sources),
    ("packing", stages.pack_sequences),
]

#: SQL can't express the learned, hashed and tokenized stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
