"""Schemas of the engine's tables (DDL strings; one constant a table)."""

from __future__ import annotations

TABLES: dict[str, str] = {
    "documents": "doc_id string, path string, title string, mime string, n_pages int, ingested_at timestamp",
    "chunks": "chunk_id string, doc_id string, idx int, text string, context_text string, headings array<string>, page_start int, page_end int, n_tokens int, modality string, path string",
    "chunk_vectors": "chunk_id string, dense array<float>",
    "chunk_blocks": "term string, rng string, n int, max_tf int, min_len int, rows array<struct<key:string,tf:int,doc_len:int>>",
    "entities": "entity_id string, name string, type string, aliases array<string>, description string, descriptions array<string>, mention_count int, aliases_text string, name_keys array<string>, pagerank double, community string, analytics_run_id string",
    "entity_vectors": "entity_id string, dense array<float>",
    "mentions": "chunk_id string, entity_id string",
    "relation_evidence": "src_id string, predicate string, dst_id string, chunk_id string, strength int, description string, seq long",
    "relations": "src_id string, predicate string, dst_id string, weight double, n_evidence long, description string, seq long",
    "degrees": "entity_id string, degree long",
    "wiki_pages": "page_id string, slug string, title string, path string, content string, content_hash string, version int, stale boolean, updated_at timestamp",
    "wiki_sections": "key string, page_id string, entity_id string, path string, section string, text string, chunk_ids array<string>",
    "section_vectors": "key string, page_id string, dense array<float>",
    "section_postings": "term string, key string, page_id string, tf int, doc_len int",
    "wiki_links": "page_id string, target_id string",
    "wiki_cites": "page_id string, chunk_id string",
    "analysis_state": "key string, revision long, run_id string, metadata string, completed_at timestamp, publications long",
    "files": "path string, doc_id string, size long, mtime double, status string, updated_at timestamp",
    "stages": "doc_id string, stage string, status string, attempts int, error string, updated_at timestamp",
    "extraction_cache": "chunk_id string, prompt_version string, model string, result_json string, seq long",
    "dirty_entities": "entity_id string",
    "meta": "key string, value string",
    "pending_removals": "doc_id string, plan_json string",
    "doc_entities": "doc_id string, entity_id string",
    "jobs": "id long, path string, fingerprint string, kind string, status string, attempts int, available_at double, error string, payload_json string, hidden boolean, created_at double, progress double, stage string",
    "desired": "path string, fingerprint string",
    "worker_heartbeat": "name string, ts double",
    "uploads": "doc_id string, name string, path string",
    "conversations": "id string, user_id string, title string, created_at timestamp",
    "messages": "id long, conversation_id string, role string, content string, mode string, sources string, status string, query string, meta string, created_at timestamp",
    "llm_usage": "id string, model string, operation string, created_at double, job_id long, external boolean, status string, tokens_in long, tokens_out long, currency string, rate_in decimal(38,18), rate_out decimal(38,18), estimated_cost decimal(38,18)",
}

#: Columns that identify a row.
KEYS: dict[str, list[str]] = {
    "documents": ["doc_id"], "chunks": ["chunk_id"], "chunk_vectors": ["chunk_id"], "chunk_blocks": ["term", "rng"],
    "entities": ["entity_id"], "entity_vectors": ["entity_id"], "mentions": ["chunk_id", "entity_id"],
    "relation_evidence": ["src_id", "predicate", "dst_id", "chunk_id"], "relations": ["src_id", "predicate", "dst_id"], "degrees": ["entity_id"], "wiki_pages": ["page_id"], "wiki_sections": ["key"], "section_vectors": ["key"], "section_postings": ["term", "key"],
    "wiki_links": ["page_id", "target_id"], "wiki_cites": ["page_id", "chunk_id"], "analysis_state": ["key"], "files": ["path"],
    "stages": ["doc_id", "stage"], "extraction_cache": ["chunk_id", "prompt_version", "model"], "dirty_entities": ["entity_id"],
    "meta": ["key"], "pending_removals": ["doc_id"], "doc_entities": ["doc_id", "entity_id"], "jobs": ["id"], "desired": ["path"],
    "worker_heartbeat": ["name"], "uploads": ["doc_id"], "conversations": ["id"], "messages": ["id"], "llm_usage": ["id"],
}

# fixed values: entity types in order, the fallback last
ENTITY_TYPES = "Person Organization Location Event Project Product Equipment Software Technology Method Concept Work Metric Regulation Substance Condition Organism Other".split()
# fixed values: stages of a document and statuses of a job, in order
STAGES = ["parse", "chunk", "embed", "extract", "graph"]
JOB_STATUSES = ["pending", "running", "done", "failed", "superseded", "cancelled"]
# fixed values: names of the answer metrics
METRICS = ["faithfulness", "answer_relevancy", "context_precision_with_reference", "context_recall", "factual_correctness"]
MODES = ["rag", "wiki", "graph", "all"]
