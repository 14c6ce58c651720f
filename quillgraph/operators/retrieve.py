"""Retrieval modes: windows around hits, cited sections, graph evidence, budgets.

Where one step depends on the steps before it (window cover, budget folds), a
query's few candidates are folded in one group of bounded size; all else is
joins and windows.  Items have the columns query_id, ord, kind, ref, text,
path, page, score.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.models import Reranker, score_column
from ..functions.text import cited_numbers, estimate_tokens, finite
from . import blockmax, graph, search
from .analytics import cut

ITEM = "query_id long, ord int, kind string, ref string, text string, path string, page int, score double"
# fixed values: defaults of retrieval
K, CANDIDATES, MAX_TOKENS, SHARES = 8, 30, 6000, {"rag": 0.4, "wiki": 0.3, "graph": 0.3}
SEEDS, HOPS, RELATIONS, SEED_SCORE = 5, 2, 30, 0.3
PARTS = ["rag", "wiki", "graph"]


def rerank(hits: DataFrame, queries: DataFrame, texts: DataFrame, model: Reranker, k: int, key: str = "chunk_id") -> DataFrame:
    """Hits in the order of the reranker, ties in the order they came in."""
    rows = hits.join(queries.select("query_id", F.col("text").alias("question")), "query_id").join(texts.select(key, F.col("text").alias("_t")), key)
    rows = rows.withColumn("relevance", score_column(model)(F.col("question"), F.col("_t")))
    order = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "rank", key)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", key, F.col("relevance").alias("score"), "rank")


def chunk_windows(hits: DataFrame, chunks: DataFrame, neighbors: int) -> DataFrame:
    """Grow each hit by up to ``neighbors`` same-heading chunks on both sides.

    Strongest first; a chunk is used once; a hit that lies in a stronger window
    gives no block of its own.  Blocks are cited by their hit.
    """
    c = chunks.select("chunk_id", "doc_id", "idx", "headings", "text", "page_start", "path")
    # few rows, of known size, so that no join moves the chunks
    own = cut(cut(hits).join(c.select("chunk_id", "doc_id", F.col("idx").alias("hit_idx"), F.col("headings").alias("hit_headings")), "chunk_id"))
    near = own.select("query_id", "rank", F.col("chunk_id").alias("hit"), "score", "doc_id", "hit_idx", "hit_headings", F.explode(F.sequence(F.col("hit_idx") - neighbors, F.col("hit_idx") + neighbors)).alias("idx"))
    rows = near.join(c, ["doc_id", "idx"]).where(F.col("headings").eqNullSafe(F.col("hit_headings")))
    rows = rows.select("query_id", "rank", "hit", "score", "doc_id", "hit_idx", "idx", "chunk_id", F.array_join("headings", " > ").alias("heading"), "text", "page_start", "path")

    def cover(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for (rank, hit), block in pdf.sort_values(["rank", "idx"]).groupby(["rank", "hit"], sort=True):
            if hit in used:
                continue
            by_idx = {r.idx: r for r in block.itertuples() if r.chunk_id not in used}
            at = block["hit_idx"].iloc[0]
            lo = hi = at
            while lo - 1 in by_idx:
                lo -= 1
            while hi + 1 in by_idx:
                hi += 1
            run = [by_idx[i] for i in range(lo, hi + 1)]
            used.update(r.chunk_id for r in run)
            pages = [r.page_start for r in run if pd.notna(r.page_start)]
            body = "\n".join(r.text for r in run)
            text = f"{run[0].heading}\n{body}" if run[0].heading else body
            out.append((key[0], len(out), "chunk", hit, text, run[0].path, min(pages) if pages else None, block["score"].iloc[0]))
        return pd.DataFrame(out, columns=[x.split()[0] for x in ITEM.split(", ")])

    return rows.groupBy("query_id").applyInPandas(cover, ITEM)


def rag(index: DataFrame, vectors: DataFrame, chunks: DataFrame, queries: DataFrame, k: int = K, neighbors: int = 0, reranker: Reranker | None = None) -> DataFrame:
    """``index`` holds blocks (``blockmax``) with lengths, postings, or the chunks themselves."""
    by_blocks = lambda index, asked, n, key: blockmax.search(index, asked, blockmax.corpus_of(index), n, key).hits
    lexical = by_blocks if "rows" in index.columns else search.bm25_texts if "text" in index.columns else search.bm25
    hits = search.hybrid(index, vectors, queries, max(k, CANDIDATES) if reranker else k, lexical=lexical)
    if reranker:
        hits = rerank(hits, queries.select("query_id", "text").dropDuplicates(["query_id"]), chunks, reranker, k)
    return chunk_windows(hits, chunks, neighbors)


def wiki(hits: DataFrame, sections: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Top sections, each followed by its own cited chunks not yet emitted.

    ``hits``: (query_id, key, score, rank).  A chunk counts where it is first
    cited; at most k distinct chunks a query; missing chunks are skipped.
    """
    s = hits.join(sections.select("key", F.col("text").alias("section_text"), "path", "chunk_ids"), "key")
    cites = s.select("query_id", "rank", F.posexplode("chunk_ids").alias("pos", "chunk_id"))
    first = cites.groupBy("query_id", "chunk_id").agg(F.min(F.struct("rank", "pos")).alias("at"))
    order = Window.partitionBy("query_id").orderBy("at", "chunk_id")
    first = first.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    found = first.join(chunks.select("chunk_id", "text", F.col("path").alias("chunk_path"), "page_start"), "chunk_id")
    a = s.select("query_id", F.col("rank").alias("r"), F.lit(-1).alias("p"), F.lit("wiki").alias("kind"), F.col("key").alias("ref"), F.col("section_text").alias("text"), "path", F.lit(None).cast("int").alias("page"), F.col("score").cast("double").alias("score"))
    b = found.select("query_id", F.col("at.rank").alias("r"), F.col("at.pos").alias("p"), F.lit("chunk").alias("kind"), F.col("chunk_id").alias("ref"), "text", F.col("chunk_path").alias("path"), F.col("page_start").alias("page"), F.lit(None).cast("double").alias("score"))
    both = a.unionByName(b)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("r", "p", "ref")) - 1
    return both.withColumn("ord", place).select([x.split()[0] for x in ITEM.split(", ")])


def graph_mode(vector_hits: DataFrame, text_hits: DataFrame, entities: DataFrame, relations: DataFrame, mentions: DataFrame, chunks: DataFrame, k: int = K, *, seeds: int = SEEDS, hops: int = HOPS, max_relations: int = RELATIONS, community_chunks: int = 3, evidence: DataFrame | None = None, degrees: DataFrame | None = None) -> DataFrame:
    """Entities, their neighbourhood's relations, evidence and community chunks.

    ``evidence`` and ``degrees`` are stored tables; without them the relations' own lists
    are taken and the edges counted.
    """
    listed = vector_hits.select("query_id", "entity_id", F.lit(0).alias("source"), F.col("rank").alias("r")).unionByName(text_hits.select("query_id", "entity_id", F.lit(1).alias("source"), F.col("position").alias("r")))
    first = listed.groupBy("query_id", "entity_id").agg(F.min(F.struct("source", "r")).alias("at"))
    by_query = Window.partitionBy("query_id")
    chosen = first.withColumn("pos", F.row_number().over(by_query.orderBy("at", "entity_id"))).where(F.col("pos") <= seeds)
    # the neighbourhood of all seeds of a query, by best position of each relation
    if degrees is None:
        edges = relations.select(F.col("src_id").alias("entity_id")).unionByName(relations.select(F.col("dst_id").alias("entity_id"))).unionByName(mentions.select("entity_id"))
        degrees = edges.groupBy("entity_id").agg(F.count(F.lit(1)).alias("degree"))
    near = graph.neighborhood(relations, degrees, chosen.select(F.col("entity_id").alias("seed_id")).distinct(), hops, max_relations)
    rel = chosen.select("query_id", F.col("entity_id").alias("seed_id")).join(near, "seed_id")
    rel = rel.groupBy("query_id", "src_id", "predicate", "dst_id").agg(F.max("weight").alias("weight"))
    rank = entities.select("entity_id", "pagerank")
    for end in ("src", "dst"):
        rel = rel.join(rank.select(F.col("entity_id").alias(f"{end}_id"), F.col("pagerank").alias(f"{end}_rank")), f"{end}_id", "left")
    # rank breaks ties only if every end of the query's relations is scored
    scored = F.min((F.col("src_rank").isNotNull() & F.col("dst_rank").isNotNull()).cast("int")).over(by_query) == 1
    tie = F.when(scored, F.col("src_rank") + F.col("dst_rank")).otherwise(0.0)
    rel = rel.withColumn("tie", tie)
    rel = rel.withColumn("pos", F.row_number().over(by_query.orderBy(F.desc("weight"), F.desc("tie"), "src_id", "predicate", "dst_id"))).where(F.col("pos") <= max_relations)
    key = ["src_id", "predicate", "dst_id"]
    if evidence is None:
        cited = rel.join(relations.select(*key, "evidence"), key).select("query_id", "pos", F.posexplode("evidence").alias("e", "chunk_id"))
    else:
        cited = rel.join(evidence.select(*key, "chunk_id", F.struct("seq", "chunk_id").alias("e")), key).select("query_id", "pos", "e", "chunk_id")
    cited = cited.groupBy("query_id", "chunk_id").agg(F.min(F.struct("pos", "e")).alias("at"))
    cited = cited.withColumn("n", F.row_number().over(by_query.orderBy("at", "chunk_id"))).where(F.col("n") <= k)
    local = cited.groupBy("query_id").agg(F.count(F.lit(1)).alias("local"))
    near_chunks = graph.community_chunks(entities, mentions, chunks, chosen.select("query_id", "pos", "entity_id"), community_chunks, exclude=cited.select("query_id", "chunk_id"))
    near_chunks = near_chunks.join(local, "query_id", "left").withColumn("quota", F.least(F.lit(community_chunks), F.when(F.coalesce("local", F.lit(0)) > 0, F.lit(k // 2)).otherwise(F.lit(k)))).where(F.col("position") <= F.col("quota"))
    has = near_chunks.select("query_id").distinct().withColumn("chunks_first", F.lit(True))
    cols = lambda part, pos, kind, ref, text, score: [F.col("query_id"), F.lit(part).alias("part"), pos.alias("p"), F.lit(kind).alias("kind"), ref.alias("ref"), text.alias("text"), score.cast("double").alias("score")]
    e = chosen.join(entities.select("entity_id", "name", "description"), "entity_id").select(cols(0, F.col("pos"), "entity", F.col("entity_id"), F.concat_ws(": ", "name", "description"), F.lit(None)))
    r = rel.select(cols(1, F.col("pos"), "relation", F.concat_ws(" ", "src_id", "predicate", "dst_id"), F.concat_ws(" ", "src_id", F.replace("predicate", F.lit("_"), F.lit(" ")), "dst_id"), F.col("weight")))
    texts = chunks.select("chunk_id", "text")
    c = cited.join(texts, "chunk_id").select(cols(2, F.col("n"), "chunk", F.col("chunk_id"), F.col("text"), F.lit(None)))
    m = near_chunks.select(cols(3, F.col("position"), "chunk", F.col("chunk_id"), F.col("text"), F.lit(None)))
    every = reduce(DataFrame.unionByName, [e, r, c, m]).join(has, "query_id", "left")
    part = F.when(F.col("chunks_first") & (F.col("part") >= 2), F.col("part") - 4).otherwise(F.col("part"))
    place = F.row_number().over(by_query.orderBy(part, "p", "ref")) - 1
    return every.withColumn("ord", place).select("query_id", "ord", "kind", "ref", "text", F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("page"), "score")


def combined(parts: dict[str, DataFrame], max_tokens: int = MAX_TOKENS, shares: dict[str, float] = SHARES) -> DataFrame:
    """Each part's items within its share of the budget, without repeats.

    An item that is too big is skipped and may still be taken by a later part,
    so the fold runs in order over a query's items.
    """
    rows = reduce(DataFrame.unionByName, [parts[p].withColumn("part", F.lit(i)) for i, p in enumerate(PARTS) if p in parts])
    rows = rows.withColumn("tokens", estimate_tokens(F.col("text")))
    budget = [int(max_tokens * shares.get(p, 0)) for p in PARTS]

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        taken, used, keep = set(), [0] * len(PARTS), []
        for r in pdf.sort_values(["part", "ord"]).itertuples():
            if (r.kind, r.ref) in taken or used[r.part] + r.tokens > budget[r.part]:
                continue
            taken.add((r.kind, r.ref))
            used[r.part] += r.tokens
            keep.append(r.Index)
        out = pdf.loc[keep].copy()
        out["ord"] = range(len(out))
        return out[[x.split()[0] for x in ITEM.split(", ")]]

    return rows.groupBy("query_id").applyInPandas(fold, ITEM)


def context_blocks(items: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Numbered blocks until the first overflow; the first item always stays."""
    w = Window.partitionBy("query_id").orderBy("ord")
    rows = items.withColumn("tokens", estimate_tokens(F.col("text"))).withColumn("used", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("number", F.row_number().over(w)).where((F.col("number") == 1) | (F.col("used") <= max_tokens))
    return rows.select("query_id", "number", "kind", "ref", F.left("text", F.lit(200)).alias("snippet"), finite(F.col("score")).alias("score"), "tokens", "used", "text")


def mark_cited(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """``cited`` where the answer (query_id, answer) names the block's number."""
    return blocks.join(answers.select("query_id", cited_numbers(F.col("answer")).alias("_n")), "query_id", "left").withColumn("cited", F.coalesce(F.array_contains("_n", F.col("number")), F.lit(False))).drop("_n")


def quick_search(q: str, entities: DataFrame, pages: DataFrame, documents: DataFrame, conversations: DataFrame, limit: int = 5) -> DataFrame:
    """Four groups of up to five: entities by prefix, pages, documents, conversations."""
    spark, needle = entities.sparkSession, F.lower(F.lit(q))
    asked = spark.createDataFrame([(0, q)], "query_id long, query string")
    group = lambda df, name, ident, label: df.select(F.lit(name).alias("group"), ident.alias("id"), label.alias("label")).orderBy("label", "id").limit(limit)
    return reduce(DataFrame.unionByName, [
        group(graph.fulltext(entities, asked, prefix=True), "entity", F.col("entity_id"), F.col("name")),
        group(pages.where(F.contains(F.lower(F.concat_ws(" ", "title", "slug")), needle)), "wiki", F.col("page_id"), F.col("title")),
        group(documents.where(F.contains(F.lower(F.regexp_extract("path", "([^/]*)$", 1)), needle)), "document", F.col("doc_id"), F.col("path")),
        group(conversations.where(F.contains(F.lower("title"), needle)), "conversation", F.col("id"), F.col("title")),
    ])
