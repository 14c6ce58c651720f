"""The engine as one object: files in, questions answered, pages and reports out.

Stages are DataFrame plans over whole batches of documents; each ends in one
commit of the store, so a crash leaves the last complete stage.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import models, text
from .operators import analytics, blockmax, build, chunking, graph, maintained, search, tables, wiki
from .operators import retrieve as modes
from .schema import ENTITY_TYPES, MODES, STAGES
from .sources import files
from .store import TableStore, upsert

QUESTION_CHARS = 16_000
NO_ANSWER = "Nothing in the corpus answers this question."


@dataclass
class Models:
    """Pluggable models; the defaults are deterministic and need no network."""

    embedder: object = field(default_factory=models.HashEmbedder)
    extractor: object = field(default_factory=lambda: models.KeywordExtractor({}))
    writer: object = field(default_factory=models.FirstLineModel)
    answerer: object = field(default_factory=models.FirstLineModel)
    translator: object | None = None
    reranker: object | None = None
    judge: object | None = None  # says "same" or "different" of two entities


class Engine:
    def __init__(self, spark: SparkSession, root: str, use: Models | None = None, *, neighbors: int = 0, max_tokens: int = modes.MAX_TOKENS):
        self.spark, self.store, self.use = spark, TableStore(spark, root), use or Models()
        self.neighbors, self.max_tokens = neighbors, max_tokens
        self.embed = models.embed_column(self.use.embedder)

    def read(self, name: str) -> DataFrame:
        return self.store.read(name)

    # --- ingest ---------------------------------------------------------

    def ingest(self, paths: list[str], *, retry_failed: bool = False, build_wiki: bool = False) -> DataFrame:
        """Parse, chunk, embed, extract and merge what is new or changed.

        Files whose content is known elsewhere only gain a path; changed files
        replace their old version.  Returns (path, doc_id, action).
        """
        self.finish_removals()
        found = analytics.cut(files.read_documents(self.spark, paths))
        plan = analytics.cut(tables.ingest_plan(found.where("error IS NULL").select("path", "doc_id"), self.read("files"), retry_failed))
        changed = plan.where("action = 'change'")
        if not changed.isEmpty():
            self._remove(changed.select("path", F.col("old_id").alias("doc_id")))
        todo = plan.where("action IN ('add', 'change', 'resume')")
        first = todo.groupBy("doc_id").agg(F.min("path").alias("path"))
        docs = analytics.cut(found.join(first, ["doc_id", "path"], "left_semi").dropDuplicates(["doc_id"]))
        now = F.current_timestamp()
        chunks = analytics.cut(chunking.chunk_documents(docs.select("doc_id", "path", "text")))
        registered = found.join(todo.select("path"), "path", "left_semi").select("path", "doc_id", "size", F.lit(None).cast("double").alias("mtime"), F.lit("done").alias("status"), now.alias("updated_at"))
        rejected = found.where("error IS NOT NULL").select("path", "doc_id", "size", F.lit(None).cast("double").alias("mtime"), F.lit("failed").alias("status"), now.alias("updated_at"))
        vectors = chunks.select("chunk_id", self.embed("context_text").alias("dense"))
        index = self._chunk_blocks(chunks)
        # keyed changes: only the buckets of these documents are written again
        new_docs, ids = docs.select("doc_id", "path", "title", "mime", "n_pages", now.alias("ingested_at")), chunks.select("chunk_id")
        ranges = chunks.select(blockmax.chunk_range(F.col("chunk_id")).alias("rng")).distinct()
        seen = registered.unionByName(rejected)
        steps = tables.set_stage(self.store.read_keys("stages", docs.select("doc_id")), self._stage_rows(docs.select("doc_id"), ["parse", "chunk", "embed"], "done"))
        self.store.merge({
            "documents": (docs.select("doc_id"), new_docs), "chunks": (ids, chunks), "chunk_vectors": (ids, vectors), "chunk_blocks": (ranges, index),
            "files": (seen.select("path"), seen.dropDuplicates(["path"])), "stages": (docs.select("doc_id"), steps),
        })
        self._extract(chunks)
        if build_wiki:
            self.build_wiki()
        return plan.select("path", "doc_id", "action")

    @staticmethod
    def _chunk_blocks(chunks: DataFrame) -> DataFrame:
        postings = search.postings(chunks, text="context_text").select("term", "chunk_id", "tf", "doc_len")
        return blockmax.blocks(postings, blockmax.chunk_range(F.col("chunk_id")), "chunk_id", lengths=True)

    @staticmethod
    def _stage_rows(docs: DataFrame, stages: list[str], status: str, error: str | None = None) -> DataFrame:
        rows = docs.distinct().select("doc_id", F.explode(F.array(*(F.lit(x) for x in stages))).alias("stage"))
        return rows.select("doc_id", "stage", F.lit(status).alias("status"), F.lit(error).cast("string").alias("error"), F.current_timestamp().alias("updated_at"))

    def _near(self, vectors: DataFrame, asked: DataFrame) -> DataFrame:
        """(new_id, candidate_id, score): entities whose vector is near."""
        hits = search.dense(vectors, asked.select(F.col("entity_id").alias("query_id"), "dense"), build.CANDIDATES + 1, "entity_id", threshold=build.ASK_FROM)
        return hits.select(F.col("query_id").alias("new_id"), F.col("entity_id").alias("candidate_id"), "score").where("new_id <> candidate_id")

    def _extract(self, chunks: DataFrame) -> None:
        """Cached or new extractions of the chunks, merged into the graph."""
        version = f"{build.PROMPT_VERSION}:{text.fingerprint(ENTITY_TYPES)[:12]}"
        name = type(self.use.extractor).__name__
        known = build.cached_extraction(chunks, self.read("extraction_cache"), version, name, any_version=False)
        ask = models.complete_column(self.use.extractor)
        asked = analytics.cut(chunks.join(known.where("result_json IS NULL").select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", "doc_id", ask("context_text").alias("r")).select("chunk_id", "doc_id", "r.reply", "r.error"))
        broken = analytics.cut(build.failed_documents(asked).where("over").select("doc_id"))
        rows = asked.where("error IS NULL").join(broken, "doc_id", "left_anti")
        cache = rows.select("chunk_id", F.lit(version).alias("prompt_version"), F.lit(name).alias("model"), F.col("reply").alias("result_json"), F.lit(time.time_ns()).alias("seq"))
        replies = known.where("result_json IS NOT NULL").select("chunk_id", F.col("result_json").alias("reply")).unionByName(rows.select("chunk_id", "reply"))
        parsed = analytics.cut(replies.select("chunk_id", F.from_json(text.clean_json(F.col("reply")), build.EXTRACTION).alias("result")))
        cleaned = analytics.cut(build.clean_entities(parsed))
        relations = build.clean_relations(parsed, cleaned)
        new = build.new_entities(cleaned)
        old = self.store.manifest()
        have = self.store.read("entities", old)
        new = analytics.cut(new)
        told = analytics.cut(new.select("entity_id", self.embed(F.concat_ws(": ", "name", "description")).alias("dense")))
        near = self._near(self.store.read("entity_vectors", old), told).unionByName(self._near(told, told))
        judge = models.complete_column(self.use.judge) if self.use.judge is not None else None
        same = build.resolve(new, have, near, judge, analytics.cut)
        new = analytics.cut(build.resolved_entities(new, same))
        merged = build.merge_entities(have, new).select("entity_id", "name", "type", "aliases", "descriptions", "description")
        fresh = new.join(have.select("entity_id"), "entity_id", "left_anti").select("entity_id", "name", "type", "aliases", "descriptions", "description").unionByName(merged)
        fresh = fresh.withColumn("name_keys", text.entity_name_keys(F.concat(F.array("name"), "aliases")))
        ident = cleaned.select("chunk_id", "norm", text.entity_id(F.col("type"), F.col("norm")).alias("entity_id"))
        ident = ident.join(same.select(F.col("new_id").alias("entity_id"), F.col("entity_id").alias("_to")), "entity_id", "left")
        ident = analytics.cut(ident.select("chunk_id", "norm", F.coalesce("_to", "entity_id").alias("entity_id")))
        fresh = analytics.cut(fresh)
        found = analytics.cut(ident.select("chunk_id", "entity_id").distinct())
        touched = analytics.cut(fresh.select("entity_id").union(found.select("entity_id")).distinct())
        mentions = self.store.read("mentions", old).join(found, ["chunk_id", "entity_id"], "left_anti").unionByName(found).join(touched, "entity_id", "left_semi")
        entities = build.upsert_entities(have.join(touched, "entity_id", "left_semi"), fresh)
        entities = analytics.cut(build.mention_counts(entities, mentions))
        end = lambda c, out: ident.select("chunk_id", F.col("norm").alias(c), F.col("entity_id").alias(out))
        facts = relations.join(end("src", "src_id"), ["chunk_id", "src"]).join(end("dst", "dst_id"), ["chunk_id", "dst"])
        facts = facts.where("src_id <> dst_id").select("src_id", "predicate", "dst_id", "chunk_id", "strength", "description", F.col("pos").cast("long").alias("seq"))
        ids = chunks.select("chunk_id")
        known = have.select("entity_id").union(entities.select("entity_id")).distinct()
        before = analytics.cut(self.store.read_keys("relation_evidence", ids, old))
        evidence = build.add_evidence(before, facts, self.store.read_keys("chunks", ids, old), known)
        evidence = analytics.cut(evidence)
        came = found.join(self.store.read("mentions", old), ["chunk_id", "entity_id"], "left_anti")
        sums = maintained.changes(lambda n, keys: self.store.read_keys(n, keys, old), (before, evidence), came, came.limit(0), analytics.cut)
        told = fresh.select("entity_id", self.embed(F.concat_ws(": ", "name", "description")).alias("dense"))
        docs = chunks.select("doc_id").distinct()
        steps = self._stage_rows(docs.join(broken, "doc_id", "left_anti"), ["extract", "graph"], "done").unionByName(self._stage_rows(broken, ["extract"], "failed", "too many chunks failed"))
        marked = tables.mark_dirty(self.store.read("dirty_entities", old), touched)
        self.store.merge(sums | {
            "entities": (touched, entities), "entity_vectors": (fresh.select("entity_id"), told), "mentions": (found, found), "relation_evidence": (ids, evidence),
            "extraction_cache": (cache.select("chunk_id", "prompt_version", "model"), cache), "dirty_entities": (marked.select("entity_id"), marked),
            "stages": (docs, tables.set_stage(self.store.read_keys("stages", docs, old), steps)),
        })

    # --- removal --------------------------------------------------------

    def remove(self, paths: list[str] | None = None, present: DataFrame | None = None) -> DataFrame:
        """Forget files at or below ``paths``, or those not in ``present``."""
        chosen = analytics.cut(tables.select_removals(self.read("files"), paths or [], present))
        self._remove(chosen.select("path", "doc_id"))
        return chosen

    def _remove(self, gone: DataFrame) -> None:
        """gone: (path, doc_id).  Documents that live on elsewhere keep their data
        and move to the surviving path; the rest are journalled, then deleted."""
        rest = self.read("files").join(gone.select("path"), "path", "left_anti")
        alive = rest.groupBy("doc_id").agg(F.min("path").alias("_live"))
        dead = analytics.cut(gone.select("doc_id").distinct().join(alive, "doc_id", "left_anti"))
        moved = self.read("documents").join(alive, "doc_id").join(gone.select(F.col("path").alias("_gone"), "doc_id"), "doc_id").where("path = _gone").withColumn("path", F.col("_live")).drop("_live", "_gone")
        old = self.store.manifest()
        self.store.commit({
            "files": rest, "documents": upsert(self.store.read("documents", old), moved, ["doc_id"]),
            "pending_removals": upsert(self.store.read("pending_removals", old), dead.withColumn("plan_json", F.lit("{}")), ["doc_id"]),
        })
        self.finish_removals()

    def finish_removals(self) -> None:
        """Delete journalled documents, their graph and pages, in one commit."""
        old = self.store.manifest()
        read = lambda n: self.store.read(n, old)
        dead = analytics.cut(read("pending_removals").select("doc_id"))
        if dead.isEmpty():
            return
        gone_chunks = analytics.cut(read("chunks").join(dead, "doc_id", "left_semi").select("chunk_id"))
        hit = self.store.read_keys("mentions", gone_chunks, old).groupBy("entity_id").agg(F.count(F.lit(1)).alias("i"))
        total = read("mentions").join(hit, "entity_id", "left_semi").groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
        plan = analytics.cut(hit.join(total, "entity_id").select("entity_id", (F.col("n") == F.col("i")).alias("removed"), (F.col("n") - F.col("i")).cast("int").alias("left")))
        dirty = analytics.cut(build.dirty_after_removal(plan, read("wiki_links"), read("wiki_cites"), gone_chunks))
        removed = plan.where("removed").select("entity_id")
        pages = removed.withColumnRenamed("entity_id", "page_id")
        # relations that lose evidence lose their description everywhere
        key = ["src_id", "predicate", "dst_id"]
        lost = self.store.read_keys("relation_evidence", gone_chunks, old).select(*key).distinct()
        touched = analytics.cut(read("relation_evidence").join(lost, key, "left_semi"))
        facts = touched.join(gone_chunks, "chunk_id", "left_anti").withColumn("description", F.lit(""))
        facts = analytics.cut(facts)
        went = self.store.read_keys("mentions", gone_chunks, old)
        sums = maintained.changes(lambda n, keys: self.store.read_keys(n, keys, old), (touched, facts), went.limit(0), went, analytics.cut)
        none = F.array().cast("array<string>")
        alive = read("entities").join(plan.where("NOT removed").select("entity_id", "left"), "entity_id")
        alive = alive.withColumn("mention_count", F.col("left")).withColumn("description", F.lit("")).withColumn("descriptions", none).drop("left")
        stale = read("wiki_pages").join(dirty.select(F.col("entity_id").alias("page_id")), "page_id", "left_semi").withColumn("stale", F.lit(True))
        empty = lambda n: read(n).limit(0)
        changes = {n: (gone_chunks, empty(n)) for n in ("chunks", "chunk_vectors", "mentions", "extraction_cache", "wiki_cites")}
        # ranges never hold chunks of two documents
        changes["chunk_blocks"] = (gone_chunks.select(blockmax.chunk_range(F.col("chunk_id")).alias("rng")).distinct(), empty("chunk_blocks"))
        changes |= {n: (pages, empty(n)) for n in ("wiki_sections", "section_vectors", "section_postings")}
        ends = read("wiki_links").join(pages.withColumnRenamed("page_id", "target_id"), "target_id", "left_semi").unionByName(read("wiki_links").join(pages, "page_id", "left_semi")).select("page_id", "target_id")
        self.store.merge(changes | sums | {
            "documents": (dead, empty("documents")), "stages": (dead, empty("stages")), "relation_evidence": (touched.select(*key, "chunk_id"), facts),
            "entities": (plan.select("entity_id"), alive), "entity_vectors": (removed, empty("entity_vectors")), "wiki_links": (ends, empty("wiki_links")),
            "wiki_pages": (pages.union(stale.select("page_id")), stale), "dirty_entities": (removed.union(dirty.select("entity_id")), dirty.select("entity_id")), "pending_removals": (dead, empty("pending_removals")),
        })

    # --- questions ------------------------------------------------------

    def _queries(self, questions: DataFrame) -> DataFrame:
        """(query_id, question) to formulations with vectors, translations included."""
        asked = F.trim("question")
        refused = F.raise_error(F.concat(F.lit(f"a question has 1 to {QUESTION_CHARS} characters: "), F.left(F.coalesce(asked, F.lit("")), F.lit(80)))).cast("string")
        q = questions.select("query_id", F.when(F.length(asked).between(1, QUESTION_CHARS), asked).otherwise(refused).alias("text")).withColumn("formulation", F.lit(0))
        if self.use.translator is not None:
            t = models.complete_column(self.use.translator)
            line = F.regexp_extract(F.trim("_t.reply"), r"^[\"'“]?([^\n\"'”]+)", 1)
            other = q.where(text.needs_translation(F.col("text"))).withColumn("_t", t("text")).withColumn("text2", line).where("_t.error IS NULL AND text2 <> '' AND text2 <> text")
            q = q.unionByName(other.select("query_id", F.col("text2").alias("text"), F.lit(1).alias("formulation")))
        return q.withColumn("dense", self.embed("text"))

    def retrieve(self, questions: DataFrame, mode: str = "rag", k: int = modes.K) -> DataFrame:
        """Context items of every question in one mode."""
        if mode not in MODES or not 1 <= k <= 100:
            raise ValueError("unknown mode, or k outside 1..100")
        q = analytics.cut(self._queries(questions))
        if mode == "all":
            return modes.combined({m: self._mode(q, m, k) for m in modes.PARTS}, self.max_tokens)
        return self._mode(q, mode, k)

    def _mode(self, q: DataFrame, mode: str, k: int) -> DataFrame:
        chunks = self.read("chunks")
        if mode == "rag":
            return modes.rag(self.read("chunk_blocks"), self.read("chunk_vectors"), chunks, q, k, self.neighbors, self.use.reranker)
        if mode == "wiki":
            found = search.hybrid(self.read("section_postings"), self.read("section_vectors"), q, k, "key")
            return modes.wiki(found, self.read("wiki_sections"), chunks, k)
        plain = q.where("formulation = 0")
        near = search.dense(self.read("entity_vectors"), plain, modes.SEEDS, "entity_id", threshold=modes.SEED_SCORE)
        named = graph.fulltext(self.read("entities"), plain.select("query_id", F.col("text").alias("query")), k=modes.SEEDS)
        return modes.graph_mode(near, named, self.read("entities"), self.relations(), self.read("mentions"), chunks, k, evidence=self.read("relation_evidence"), degrees=self.read("degrees"))

    def relations(self) -> DataFrame:
        """The stored relations, which ingest and removal keep up to date."""
        return self.read("relations")

    def ask(self, questions: DataFrame, mode: str = "rag", k: int = modes.K) -> DataFrame:
        """query_id, question, mode, answer, sources; without context a fixed text."""
        blocks = analytics.cut(modes.context_blocks(self.retrieve(questions, mode, k), self.max_tokens))
        context = blocks.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "text"))), lambda b: F.concat(F.lit("["), b["number"].cast("string"), F.lit("] "), b["text"])), "\n\n").alias("context"))
        prompt = F.concat(F.lit("Question: "), F.col("question"), F.lit("\n\n"), F.col("context"))
        rows = questions.join(context, "query_id", "left").withColumn("_a", models.complete_column(self.use.answerer)(F.coalesce(prompt, F.lit(""))))
        answers = rows.select("query_id", "question", F.lit(mode).alias("mode"), F.when(F.col("context").isNull(), NO_ANSWER).otherwise(F.col("_a.reply")).alias("answer"), "_a.error")
        cited = modes.mark_cited(blocks, answers).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("number", "kind", "ref", "snippet", "score", "cited"))).alias("sources"))
        return answers.join(cited, "query_id", "left")

    def compare(self, questions: DataFrame, path: str, k: int = modes.K) -> DataFrame:
        """Every question in every mode; the rows are appended together."""
        ts = F.lit(time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()))
        rows = None
        for m in MODES:
            out = self.ask(questions, m, k).withColumn("ts", ts)
            rows = out if rows is None else rows.unionByName(out)
        rows = analytics.cut(rows)
        files.append_jsonl(rows, path)
        return rows

    # --- wiki and analysis ----------------------------------------------

    def build_wiki(self, rebuild_all: bool = False) -> dict[str, int]:
        """Write dirty eligible pages, drop ineligible ones, keep failures dirty."""
        old = self.store.manifest()
        read = lambda n: self.store.read(n, old)
        entities = read("entities")
        todo = entities.select("entity_id").join(read("entity_vectors"), "entity_id")
        nearest = search.for_entity(read("chunk_vectors"), read("mentions"), todo, wiki.EVIDENCE)
        out = wiki.build(entities, self.relations(), read("wiki_pages"), read("dirty_entities"), nearest, read("wiki_cites"), read("mentions"), models.complete_column(self.use.writer), read("chunks"), rebuild_all=rebuild_all, cut=analytics.cut)
        pages, dropped, failed, cites, links = (analytics.cut(out[n]) for n in ("pages", "dropped", "failed", "cites", "links"))
        gone = pages.select("page_id").union(dropped.select("page_id"))
        body = wiki.parse_page(F.col("content"))[1]
        sections = wiki.split_sections(pages.select("page_id", "title", body.alias("body"), "path"))
        sections = analytics.cut(sections.join(pages.select("page_id", "path"), "page_id").withColumn("entity_id", F.col("page_id")))
        live = upsert(read("wiki_pages").join(dropped, "page_id", "left_anti"), pages, ["page_id"])
        without = lambda n: read(n).join(gone, "page_id", "left_anti")
        linkers = graph.pages_linking_to(read("wiki_links"), dropped).select(F.col("page_id").alias("entity_id"))
        self.store.commit({
            "wiki_pages": live, "wiki_sections": without("wiki_sections").unionByName(sections, allowMissingColumns=True),
            "section_vectors": without("section_vectors").unionByName(self._section_vectors(sections)), "section_postings": without("section_postings").unionByName(self._section_postings(sections)), "wiki_cites": without("wiki_cites").unionByName(cites),
            "wiki_links": without("wiki_links").unionByName(links.select("page_id", "target_id")), "dirty_entities": upsert(failed.select("entity_id"), linkers, ["entity_id"]),
        })
        return {"written": pages.count(), "dropped": dropped.count(), "failed": failed.count()}

    def _section_vectors(self, sections: DataFrame) -> DataFrame:
        return sections.select("key", "page_id", self.embed("text").alias("dense"))

    def _section_postings(self, sections: DataFrame) -> DataFrame:
        return search.postings(sections, "key").join(sections.select("key", "page_id"), "key").select("term", "key", "page_id", "tf", "doc_len")

    def analyze(self, estimate_only: bool = False, max_nodes: int | None = None, max_relations: int | None = None) -> dict:
        return analytics.analyze(self.store, uuid.uuid4().hex, estimate_only, max_nodes, max_relations)

    def reindex(self) -> int:
        """Recompute all vectors, the block index and the sums of the graph; one commit."""
        chunks, entities = self.read("chunks"), self.read("entities")
        relations, degrees = maintained.rebuilt(self.read("relation_evidence"), self.read("mentions"))
        self.store.commit({
            "relations": relations, "degrees": degrees,
            "chunk_vectors": chunks.select("chunk_id", self.embed("context_text").alias("dense")),
            "chunk_blocks": self._chunk_blocks(chunks),
            "entity_vectors": entities.select("entity_id", self.embed(F.concat_ws(": ", "name", "description")).alias("dense")),
            "section_vectors": self._section_vectors(self.read("wiki_sections")), "section_postings": self._section_postings(self.read("wiki_sections")),
        })
        return chunks.count()

    # --- status ---------------------------------------------------------

    def status(self) -> DataFrame:
        names = ["documents", "chunks", "entities", "mentions", "relation_evidence", "wiki_pages", "dirty_entities", "pending_removals"]
        return tables.stats(self.read("files"), {n: self.read(n) for n in names})

    def snapshot(self) -> DataFrame:
        """Fingerprints of the corpus tables, to tell if anything changed."""
        one = lambda n, *c: tables.corpus_fingerprint(self.read(n), *c).select(F.lit(n).alias("table"), "fingerprint", "rows")
        return one("files", "path", "doc_id", "status").unionByName(one("dirty_entities", "entity_id")).unionByName(one("wiki_pages", "page_id", "content_hash"))

    def failed_paths(self) -> DataFrame:
        return tables.failed_paths(self.read("files"), self.read("stages"))

    def document(self, doc_id: str) -> DataFrame:
        """A document's stages; what was never run is pending."""
        docs = self.spark.createDataFrame([(doc_id,)], "doc_id string")
        return tables.stage_table(docs, self.read("stages")).withColumn("of", F.lit(len(STAGES))).orderBy("pos")

    def entities(self, **filters) -> DataFrame:
        return graph.list_entities(self.read("entities"), **filters)

    def entity(self, entity_id: str) -> DataFrame:
        ids = self.spark.createDataFrame([(entity_id,)], "entity_id string")
        return graph.node_views(self.read("entities"), self.relations(), self.read("wiki_pages"), ids, self.store.manifest()["run_id"])

    def newest_chunks(self, limit: int = 20) -> DataFrame:
        d = self.read("documents").orderBy(F.desc("ingested_at"), "doc_id").limit(limit)
        c = self.read("chunks").join(d.select("doc_id"), "doc_id", "left_semi")
        return c.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("idx"))).where("_n = 1").drop("_n")
