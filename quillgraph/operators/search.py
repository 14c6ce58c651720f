"""Lexical, dense and hybrid search as joins and windows.

All operators take a frame of queries, so a batch of questions is one plan.
Lexical search meets postings by term in an equi-join; postings can be cut to the
terms that are asked before they are counted.  Dense search is a grid of matrix
products (``nearest``).  Lists are fused by reciprocal rank.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import cosine
from .analytics import cut
from .nearest import nearest
from .sparse import numbered, sparse_topk, text_topk

# fixed values: BM25, fusion and prefetch
K1, B, RRF_K, PREFETCH = 1.2, 0.75, 2, 4


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def postings(chunks: DataFrame, key: str = "chunk_id", text: str = "text", terms: DataFrame | None = None) -> DataFrame:
    """term, key, tf, doc_len: term counts, combined within a task first.

    With ``terms`` (term) only these are kept, before anything is counted or moved.
    """
    words = chunks.select(key, tokens(F.col(text)).alias("_w"))
    words = words.select(key, F.size("_w").alias("doc_len"), F.explode("_w").alias("term"))
    if terms is not None:
        words = words.join(terms, "term", "left_semi")
    return words.groupBy("term", key, "doc_len").agg(F.count(F.lit(1)).cast("int").alias("tf"))


def asked_terms(queries: DataFrame) -> DataFrame:
    """The distinct terms of (query_id, text)."""
    return queries.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).distinct()


def lengths(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, doc_len) of everything that holds a term; no shuffle."""
    return chunks.select(key, F.size(tokens(F.col(text))).alias("doc_len")).where("doc_len > 0")


def bm25(index: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", corpus: DataFrame | None = None) -> DataFrame:
    """query_id, key, score, rank: the k best; queries: (query_id, text).

    ``corpus`` (key, doc_len) gives the averages; else they come from the index,
    which then must hold all terms.
    """
    docs = (corpus if corpus is not None else index.select(key, "doc_len").distinct()).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("doc_len").alias("avg_len"))
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    used = index if corpus is not None else index.join(asked.select("term").distinct(), "term", "left_semi")
    terms = numbered(used.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    idf = F.log1p((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("avg_len")))
    docs = cut(docs)  # one row
    rows = used.join(terms, "term").join(F.broadcast(docs)).select(key, F.col("_t").alias("t"), weight.alias("w"))
    want = asked.join(terms, "term").join(F.broadcast(docs)).select("query_id", F.col("_t").alias("t"), idf.alias("w"))
    return top_k(sparse_topk(rows, want, k, key), k, key)


def bm25_texts(chunks: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """query_id, key, score, rank: the k best of texts that aren't indexed; a key is one row.

    No postings are made: one pass counts the rows of each term, and the words go to the
    cells of the grid as they are, where those of the questions are looked up and counted.
    """
    words = chunks.select(key, tokens(F.col(text)).alias("_w"))
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    # the term '' stands for all rows
    each = words.select(F.explode(F.array_append(F.array_distinct("_w"), F.lit(""))).alias("term"), F.size("_w").alias("n"))
    counts = each.groupBy("term").agg(F.count_if(F.col("n") > 0).alias("df"), F.sum("n").alias("length"))
    none = queries.sparkSession.range(1).select(F.lit("").alias("term"))
    counts = cut(counts.join(asked.select("term").unionByName(none).distinct(), "term", "left_semi"))
    whole = counts.where("term = ''").select("df", "length").first()
    n_docs, length = (whole.df, whole.length) if whole else (0, 0)
    idf = F.log1p((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    want = asked.join(counts.where("term <> ''"), "term").select("query_id", "term", idf.alias("w"))
    rows = words.select(key, F.coalesce(F.array_join("_w", " "), F.lit("")).alias("_words"))
    mean = length / max(1, n_docs)
    return top_k(text_topk(rows, want, k, key, n_docs, length, lambda tf, n: tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / mean))), k, key)


def shared_terms(index: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id") -> DataFrame:
    """query_id, key, score, rank: the k rows that share most terms."""
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    terms = numbered(asked.select("term").distinct())
    one = lambda df, name: df.join(terms, "term").select(name, F.col("_t").alias("t"), F.lit(1.0).alias("w"))
    found = sparse_topk(one(index, key), one(asked, "query_id"), k, key)
    return top_k(found.withColumn("score", F.col("score").cast("long")), k, key)


def top_k(scored: DataFrame, k: int, key: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def dense(vectors: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", threshold: float | None = None, tile: int | None = None) -> DataFrame:
    """Cosine top k: vectors (key, dense), queries (query_id, dense), of which a task
    holds ``tile`` at a time."""
    return top_k(nearest(vectors, queries, k, key, threshold, tile), k, key)


def dense_within(vectors: DataFrame, queries: DataFrame, k: int, key: str, group: str) -> DataFrame:
    """Cosine top k among the vectors of a question's group: (key, dense, group) and
    (query_id, dense, group).  A row or question that has no cosine with the others (null,
    zero, not finite or of a length that isn't the group's usual one) is paired
    one by one: such pairs have no score and come last.
    """
    fit = F.forall("dense", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("dense", lambda x: x != 0)
    plain = vectors.where(F.coalesce(fit, F.lit(False))).groupBy(group).agg(F.mode(F.size("dense"), True).alias("_usual"))
    marked = lambda df: df.where(F.col(group).isNotNull()).join(plain, group, "left").withColumn("_fit", F.coalesce(fit & (F.size("dense") == F.col("_usual")), F.lit(False))).drop("_usual")
    v, q = marked(vectors), marked(queries)
    near = nearest(v.where("_fit"), q.where("_fit"), k, key, group=group)
    own = q.select("query_id", group, F.col("dense").alias("q"), F.col("_fit").alias("_fit_q"))
    other = v.select(key, group, "dense", "_fit")
    pairs = own.join(other.where("NOT _fit"), group).unionByName(own.where("NOT _fit_q").join(other.where("_fit"), group))
    odd = pairs.select("query_id", key, F.round(cosine(F.col("dense"), F.col("q")), 6).alias("score"))
    return top_k(near.unionByName(odd), k, key)


def fuse(lists: list[DataFrame], k: int, key: str = "chunk_id", c: float = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of (query_id, key, rank from 1) lists: sum of 1/(c + rank - 1)."""
    ranked = reduce(DataFrame.unionByName, [x.select("query_id", key, "rank") for x in lists])
    scored = ranked.groupBy("query_id", key).agg(F.round(F.sum(1 / (F.lit(float(c)) + F.col("rank") - 1)), 6).alias("score"))
    return top_k(scored, k, key)


def hybrid(index: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", lexical=bm25, near=dense) -> DataFrame:
    """queries: (query_id, formulation, text, dense).  Every formulation gives a
    dense and a lexical list of 4k; all lists of a query are fused.  ``lexical`` takes
    (index, queries, k, key), ``near`` (vectors, queries, k, key)."""
    each = queries.withColumn("of", F.col("query_id")).withColumn("query_id", F.struct("query_id", "formulation"))
    lists = [lexical(index, each, PREFETCH * k, key), near(vectors, each, PREFETCH * k, key)]
    back = [x.select(F.col("query_id.query_id").alias("query_id"), key, "rank") for x in lists]
    return fuse(back, k, key)


def for_entity(vectors: DataFrame, mentions: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Nearest mentioning chunks of each (entity_id, dense): an equi-join on the
    mentions, never all chunks against all entities."""
    own = mentions.join(asked.select("entity_id", F.col("dense").alias("q")), "entity_id").join(vectors, "chunk_id")
    scored = own.select(F.col("entity_id").alias("query_id"), "chunk_id", F.round(cosine(F.col("dense"), F.col("q")), 6).alias("score"))
    return top_k(scored, k, "chunk_id").withColumnRenamed("query_id", "entity_id")


def by_name(entities: DataFrame, keys: DataFrame, limit: int) -> DataFrame:
    """Entities that share a name key with a query: keys (query_id, name_keys).

    A key's ``limit`` least entities are all that a query can use of it, so only these
    are joined and a common name doesn't multiply rows.
    """
    have = entities.select("entity_id", F.explode("name_keys").alias("k")).distinct()
    have = have.withColumn("_n", F.row_number().over(Window.partitionBy("k").orderBy("entity_id"))).where(F.col("_n") <= limit).drop("_n")
    hits = keys.select("query_id", F.explode("name_keys").alias("k")).join(have, "k").select("query_id", "entity_id").distinct()
    order = Window.partitionBy("query_id").orderBy("entity_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def check_dimension(vectors: DataFrame, dim: int) -> DataFrame:
    """One row (rows, bad): vectors whose length isn't ``dim``."""
    return vectors.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~(F.size("dense") == dim)).alias("bad"))
