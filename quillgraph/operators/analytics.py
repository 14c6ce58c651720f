"""PageRank, and the publication of ranks and communities."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITERATIONS, DAMPING = 20, 0.85
CUT_EVERY = 5


def weighted_edges(relations: DataFrame) -> DataFrame:
    """(a, b, w) in both directions; parallel relations add up, loops fall out."""
    e = relations.where("src_id <> dst_id").select(F.col("src_id").alias("a"), F.col("dst_id").alias("b"), F.col("weight").alias("w"))
    return e.union(e.select("b", "a", "w")).groupBy("a", "b").agg(F.sum("w").alias("w"))


def cut(df: DataFrame) -> DataFrame:
    """End the lineage in the folder that the cluster shares."""
    spark: SparkSession = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        import tempfile

        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="quillgraph-"))
    path = f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/analytics/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete cut tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_written_to", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def pagerank(nodes: DataFrame, relations: DataFrame, iterations: int = ITERATIONS, damping: float = DAMPING) -> DataFrame:
    """entity_id, pagerank: weighted, undirected, not normalised.

    Edges lie partitioned by their source and entities by their id, both kept on
    the executors (a lost one is read again from the cut table).  The sum by target
    leaves ranks partitioned like the sources, so a step moves partial sums only:
    one exchange, in which hubs don't gather rows.  Steps move numbers, not names.
    """
    from .communities import numbered

    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = cut(numbered(nodes))
    end = lambda name, to: names.select(F.col("entity_id").alias(name), F.col("node").alias(to))
    # what is no entity has no number: it takes its share, and gives none
    e = relations.where("src_id <> dst_id").select("src_id", "dst_id", F.col("weight").alias("w"))
    e = e.join(end("src_id", "a"), "src_id", "left").join(end("dst_id", "b"), "dst_id", "left").select("a", "b", "w")
    e = e.union(e.select("b", "a", "w")).where("a IS NOT NULL").groupBy("a", "b").agg(F.sum("w").alias("w"))
    out = e.groupBy("a").agg(F.sum("w").alias("total"))
    edges = cut(e.join(out, "a").where("b IS NOT NULL").select("a", "b", (F.col("w") / F.col("total")).alias("share")))
    share = edges.repartition(n, "a").persist(StorageLevel.MEMORY_AND_DISK)
    ids = names.select("node").repartition(n, "node").persist(StorageLevel.MEMORY_AND_DISK)
    rank, last = ids.withColumn("pagerank", F.lit(1.0 - damping)), None
    for i in range(iterations):
        flow = share.join(rank.withColumnRenamed("node", "a"), "a").groupBy("b").agg(F.sum(F.col("share") * F.col("pagerank")).alias("f"))
        rank = ids.join(flow.withColumnRenamed("b", "node"), "node", "left").select("node", (F.lit(1.0 - damping) + F.lit(damping) * F.coalesce("f", F.lit(0.0))).alias("pagerank"))
        if i % CUT_EVERY == CUT_EVERY - 1:
            before, rank = last, cut(rank)
            last = rank
            drop(*([before] if before is not None else []))
    before, rank = last, cut(names.join(rank, "node").select("entity_id", "pagerank"))
    drop(*([before] if before is not None else []))
    share.unpersist()
    ids.unpersist()
    drop(edges, names)
    return rank


#: Bytes of a node and of one direction of a relation in the working tables.
NODE_BYTES, EDGE_BYTES = 64, 48


def analyze(store, run_id: str | None = None, estimate_only: bool = False, max_nodes: int | None = None, max_relations: int | None = None) -> dict:
    """Both algorithms, and publication if the revision hasn't moved.

    A graph with weights that aren't positive and finite, or over the caller's limits,
    is refused.  ``projection_bytes`` estimates the working tables of a round.
    """
    from . import build, communities
    from .graph import MAX_DOUBLE

    manifest = store.manifest()
    entities, evidence = store.read("entities", manifest), store.read("relation_evidence", manifest)
    rel = cut(build.relation_weights(evidence))
    good = (F.col("weight") > 0) & (F.col("weight") <= MAX_DOUBLE)
    n, m, bad = entities.count(), rel.count(), rel.where(~F.coalesce(good, F.lit(False))).count()
    report = {"nodes": n, "relations": m, "bad_weights": bad, "revision": manifest["revision"], "projection_bytes": n * NODE_BYTES + 2 * m * EDGE_BYTES}
    if bad or (max_nodes is not None and n > max_nodes) or (max_relations is not None and m > max_relations):
        raise ValueError(f"analysis refused: {report}")
    if estimate_only or not n:
        return report | {"published": False}
    run_id = run_id or uuid.uuid4().hex
    scored = pagerank(entities, rel).join(communities.communities(entities, rel), "entity_id").withColumn("analytics_run_id", F.lit(run_id))
    scored = cut(scored)
    if scored.count() != n:
        raise ValueError("the analysis doesn't cover all entities")
    rows = entities.drop("pagerank", "community", "analytics_run_id").join(scored, "entity_id")
    report["communities"] = scored.select("community").distinct().count()
    return report | {"run_id": run_id, "published": store.publish_analysis(manifest["revision"], rows, run_id)}
