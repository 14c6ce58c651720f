"""Data logic of graph views: filters, facets, summaries over a loaded part."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import induced, undirected

RELATION = ["src_id", "predicate", "dst_id"]


def build_graph(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations whose ends exist; of repeated keys the heaviest stays."""
    order = Window.partitionBy(*RELATION).orderBy(F.desc("weight"))
    return induced(relations, nodes).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def visible(nodes: DataFrame, relations: DataFrame, *, types: list[str] = (), community: str | None = None, min_mentions: int = 0, min_weight: float = 0.0, predicates: list[str] = (), hide_isolated: bool = False) -> tuple[DataFrame, DataFrame]:
    n = nodes.where(F.col("mention_count") >= min_mentions)
    if types:
        n = n.where(F.col("type").isin(list(types)))
    if community is not None:
        n = n.where(F.col("community") == community)
    e = relations.where(F.col("weight") >= min_weight)
    if predicates:
        e = e.where(F.col("predicate").isin(list(predicates)))
    e = induced(e, n)
    if hide_isolated:
        n = n.join(undirected(e).select("entity_id").distinct(), "entity_id", "left_semi")
    return n, e


def size_metric(nodes: DataFrame) -> DataFrame:
    """One row: pagerank, or mentions if any node lacks a rank; least and most."""
    lacks = F.coalesce(F.bool_or(F.col("pagerank").isNull()), F.lit(True))
    ok = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c))
    return nodes.agg(lacks.alias("_l"), F.min(ok("pagerank")).alias("_a"), F.max(ok("pagerank")).alias("_b"), F.min("mention_count").cast("double").alias("_c"), F.max("mention_count").cast("double").alias("_d")).select(F.when(F.col("_l"), "mentions").otherwise("pagerank").alias("metric"), F.when(F.col("_l"), F.col("_c")).otherwise(F.col("_a")).alias("low"), F.when(F.col("_l"), F.col("_d")).otherwise(F.col("_b")).alias("high"))


def merge_parts(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union in which the first part that holds a key wins."""
    rows = reduce(DataFrame.unionByName, [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)])
    names = [c for c in rows.columns if c not in (*keys, "_part")]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*names), "_part").alias("_r")).select(*keys, "_r.*")


def community_summaries(nodes: DataFrame, top: int = 3) -> DataFrame:
    score = F.coalesce("pagerank", F.col("mention_count") / 1e6)
    order = Window.partitionBy("community").orderBy(score.desc(), "entity_id")
    own = nodes.where(F.col("community").isNotNull()).withColumn("_n", F.row_number().over(order))
    g = own.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_list(F.when(F.col("_n") <= top, F.struct("_n", "name")))).alias("_t"))
    names = F.transform("_t", lambda x: x["name"])
    label = F.concat(F.array_join(F.slice(names, 1, 2), ", "), F.when(F.col("size") > 2, F.concat(F.lit(" and "), (F.col("size") - 2).cast("string"), F.lit(" more"))).otherwise(""))
    return g.select("community", "size", names.alias("names"), label.alias("label")).orderBy(F.desc("size"), "community")


def type_counts(nodes: DataFrame, **filters) -> DataFrame:
    """Visible nodes a type, whatever types are selected."""
    filters.pop("types", None)
    return visible(nodes, nodes.sparkSession.createDataFrame([], "src_id string, predicate string, dst_id string, weight double"), **filters)[0].groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def predicate_counts(nodes: DataFrame, relations: DataFrame, selected: list[str] = (), **filters) -> DataFrame:
    """predicate, total, visible; selected but absent predicates at the end with 0."""
    filters.pop("predicates", None)
    total = relations.groupBy("predicate").agg(F.count(F.lit(1)).alias("total"))
    seen = visible(nodes, relations, **filters)[1].groupBy("predicate").agg(F.count(F.lit(1)).alias("visible"))
    out = total.join(seen, "predicate", "left").na.fill(0)
    if selected:
        wanted = nodes.sparkSession.createDataFrame([(p,) for p in selected], "predicate string")
        out = out.unionByName(wanted.join(total, "predicate", "left_anti").select("predicate", F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("visible")))
    return out.orderBy(F.desc("total"), "predicate")


def top_relations(relations: DataFrame, asked: DataFrame, limit: int = 8) -> DataFrame:
    order = Window.partitionBy("entity_id").orderBy(F.desc("weight"), "src_id", "predicate", "dst_id", "direction")
    return undirected(relations).join(asked, "entity_id", "left_semi").withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)


def rank_by_pagerank(nodes: DataFrame, limit: int = 1000) -> DataFrame:
    """Top nodes with their rank: a distributed top-k, then numbers on its few rows."""
    top = nodes.orderBy(F.col("pagerank").desc_nulls_last(), "entity_id").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("pagerank").desc_nulls_last(), "entity_id")))


def one_step(relations: DataFrame, nodes: DataFrame, entity_id: str) -> DataFrame:
    near = undirected(relations).where(F.col("entity_id") == entity_id).select(F.col("other_id").alias("entity_id")).distinct()
    return nodes.join(near, "entity_id", "left_semi")


def shown_types(nodes: DataFrame, configured: list[str], selected: list[str] = ()) -> DataFrame:
    """Configured types that are present or selected, in order, then other present ones."""
    there = nodes.select("type").distinct().withColumn("_there", F.lit(True))
    known = nodes.sparkSession.createDataFrame([(i, t, t in set(selected)) for i, t in enumerate(configured)], "pos int, type string, selected boolean")
    out = known.join(there, "type", "full_outer").where(F.coalesce("_there", F.lit(False)) | F.coalesce("selected", F.lit(False)))
    return out.orderBy(F.col("pos").asc_nulls_last(), "type").select("type", "pos")
