"""Registry, work queue, accounting and service tables.

State is rows; a state machine's step is a function from a table to its next
version, and its whole history is a fold over an ordered event log per key.
"""

from __future__ import annotations

import json
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import JOB_STATUSES, STAGES

ATTEMPTS, DELAY, DELAY_CAP, STALE_WORKER = 5, 30.0, 3600.0, 120.0
FINISHED = ["done", "superseded", "cancelled"]

# --- registry -------------------------------------------------------------


def recent_files(files: DataFrame, limit: int) -> DataFrame:
    return files.orderBy(F.col("updated_at").desc_nulls_last(), "path").limit(limit)


def stage_table(docs: DataFrame, stages: DataFrame) -> DataFrame:
    """Every document's stages in order; a missing row is pending."""
    names = docs.sparkSession.createDataFrame(list(enumerate(STAGES)), "pos int, stage string")
    out = docs.select("doc_id").distinct().join(F.broadcast(names)).join(stages, ["doc_id", "stage"], "left")
    return out.select("doc_id", "stage", "pos", F.coalesce("status", F.lit("pending")).alias("status"), F.coalesce("attempts", F.lit(0)).alias("attempts"), "error")


def set_stage(stages: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: (doc_id, stage, status, error, updated_at); running adds an attempt."""
    old = stages.select("doc_id", "stage", F.col("attempts").alias("_a"))
    new = changes.join(old, ["doc_id", "stage"], "left").withColumn("attempts", F.coalesce("_a", F.lit(0)) + (F.col("status") == "running").cast("int")).drop("_a")
    return stages.join(changes.select("doc_id", "stage"), ["doc_id", "stage"], "left_anti").unionByName(new, allowMissingColumns=True)


def reset_running(rows: DataFrame) -> DataFrame:
    return rows.withColumn("status", F.when(F.col("status") == "running", "pending").otherwise(F.col("status")))


def stage_summary(stages: DataFrame, statuses: list[str], stage: str = "stage", status: str = "status") -> DataFrame:
    """One row a stage, a column a status; absent cells are 0."""
    return stages.groupBy(stage).agg(*(F.count_if(F.col(status) == s).alias(s) for s in statuses)).orderBy(stage)


def latest_extraction(cache: DataFrame) -> DataFrame:
    return cache.groupBy("chunk_id").agg(F.max_by(F.struct("prompt_version", "model", "result_json"), "seq").alias("e"), F.max("seq").alias("seq")).select("chunk_id", "e.*", "seq")


def failed_paths(files: DataFrame, stages: DataFrame) -> DataFrame:
    """Files that failed themselves or whose document has a failed stage."""
    bad = stages.where("status = 'failed'").select("doc_id").distinct().withColumn("_bad", F.lit(True))
    return files.join(bad, "doc_id", "left").where(F.coalesce("_bad", F.lit(False)) | (F.col("status") == "failed")).drop("_bad").orderBy("path")


def clear_document(stages: DataFrame, cache: DataFrame, doc_id: str) -> tuple[DataFrame, DataFrame]:
    return stages.where(F.col("doc_id") != doc_id), cache.where(~F.startswith("chunk_id", F.lit(f"{doc_id}:")))


def insert_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return table.unionByName(rows.dropDuplicates(keys).join(table, keys, "left_anti"), allowMissingColumns=True)


def mark_dirty(dirty: DataFrame, ids: DataFrame) -> DataFrame:
    return dirty.unionByName(ids.select("entity_id")).distinct()


def clear_dirty(dirty: DataFrame, ids: DataFrame) -> DataFrame:
    return dirty.join(ids.select("entity_id"), "entity_id", "left_anti")


def set_chunk_entities(payload: DataFrame, changes: DataFrame) -> DataFrame:
    """payload: (chunk_id, doc_id, path, entity_ids); changes: (chunk_id, entity_ids)."""
    new = changes.select("chunk_id", F.col("entity_ids").alias("_e"))
    return payload.join(new, "chunk_id", "left").withColumn("entity_ids", F.coalesce("_e", "entity_ids")).drop("_e")


def set_doc_path(payload: DataFrame, changes: DataFrame) -> DataFrame:
    """The same of paths, by document: changes (doc_id, path)."""
    new = changes.select("doc_id", F.col("path").alias("_p"))
    return payload.join(new, "doc_id", "left").withColumn("path", F.coalesce("_p", "path")).drop("_p")


def load_chunks(cache: DataFrame, graph_chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Cached chunks; what the cache lacks or holds without text is taken from the graph."""
    good = cache.where("text IS NOT NULL")
    return good.unionByName(graph_chunks.join(good.select("doc_id").distinct(), "doc_id", "left_anti").select(cache.columns))


def job_page(jobs: DataFrame, limit: int = 100, offset: int = 0, include_hidden: bool = False) -> DataFrame:
    """Jobs, newest first."""
    rows = jobs if include_hidden else jobs.where(~F.coalesce("hidden", F.lit(False)))
    return rows.orderBy(F.col("id").desc()).offset(offset).limit(limit)


def document_entities(mentions: DataFrame, chunks: DataFrame, recorded: DataFrame) -> DataFrame:
    """(doc_id, entity_id): mentioned in the document's chunks, or recorded for it."""
    return mentions.join(chunks.select("chunk_id", "doc_id"), "chunk_id").select("doc_id", "entity_id").unionByName(recorded.select("doc_id", "entity_id")).distinct()


# --- queue ----------------------------------------------------------------


def backoff(attempts: Column, delay: float = DELAY) -> Column:
    return F.least(F.lit(delay) * F.pow(F.lit(2.0), F.least(attempts - 1, F.lit(16))), F.lit(DELAY_CAP))


def ready(jobs: DataFrame, now: float, kind: str | None = None, max_attempts: int | None = None) -> DataFrame:
    out = jobs.where((F.col("status") == "pending") & (F.coalesce("available_at", F.lit(0.0)) <= now))
    if kind is not None:
        out = out.where(F.col("kind") == kind)
    return out if max_attempts is None else out.where(F.col("attempts") < max_attempts)


def claim(jobs: DataFrame, now: float, max_attempts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(next jobs, claimed): the oldest ready job runs with one more attempt."""
    first = ready(jobs, now, max_attempts=max_attempts).agg(F.min("id").alias("_first"))
    out = jobs.join(F.broadcast(first))
    hit = F.col("id") == F.col("_first")
    out = out.withColumn("status", F.when(hit, "running").otherwise(F.col("status"))).withColumn("attempts", F.col("attempts") + F.coalesce(hit.cast("int"), F.lit(0)))
    return out.drop("_first"), out.where(hit).drop("_first")


def _change(jobs: DataFrame, where: Column, **values: Column) -> DataFrame:
    for name, value in values.items():
        jobs = jobs.withColumn(f"_{name}", F.when(where, value).otherwise(F.col(name)))
    for name in values:
        jobs = jobs.drop(name).withColumnRenamed(f"_{name}", name)
    return jobs


def fail(jobs: DataFrame, job_id: int, error: str, now: float, max_attempts: int = ATTEMPTS, delay: float = DELAY) -> DataFrame:
    over = F.col("attempts") >= max_attempts
    return _change(jobs, (F.col("id") == job_id) & (F.col("status") == "running"), status=F.when(over, "failed").otherwise("pending"), available_at=F.when(over, F.col("available_at")).otherwise(F.lit(now) + backoff(F.col("attempts"), delay)), error=F.lit(error))


def finish(jobs: DataFrame, desired: DataFrame, job_id: int) -> DataFrame:
    """Done; if it is its path's desired version, waiting siblings are superseded."""
    job = jobs.where(F.col("id") == job_id).join(desired, ["path", "fingerprint"], "left_semi").select(F.col("path").alias("_p"))
    out = _change(jobs, F.col("id") == job_id, status=F.lit("done")).join(F.broadcast(job), F.col("path") == F.col("_p"), "left")
    return _change(out, F.col("_p").isNotNull() & (F.col("id") != job_id) & F.col("status").isin("pending", "failed"), status=F.lit("superseded")).drop("_p")


def release(jobs: DataFrame, job_id: int, now: float, delay: float) -> DataFrame:
    return _change(jobs, (F.col("id") == job_id) & (F.col("status") == "running"), status=F.lit("pending"), attempts=F.greatest(F.col("attempts") - 1, F.lit(0)), available_at=F.lit(now + delay))


def defer(jobs: DataFrame, job_id: int, now: float, delay: float) -> DataFrame:
    return _change(jobs, F.col("id") == job_id, status=F.lit("pending"), available_at=F.lit(now + delay))


def recover(jobs: DataFrame, max_attempts: int | None = None) -> DataFrame:
    """After a crash running jobs wait again, or have failed for good; attempts stay."""
    over = F.lit(False) if max_attempts is None else F.col("attempts") >= max_attempts
    return _change(jobs, F.col("status") == "running", status=F.when(over, "failed").otherwise("pending"))


def retry(jobs: DataFrame, job_id: int | None = None) -> DataFrame:
    which = F.col("status") == "failed"
    return _change(jobs, which if job_id is None else which & (F.col("id") == job_id), status=F.lit("pending"), attempts=F.lit(0), available_at=F.lit(0.0))


def cancel(jobs: DataFrame, job_id: int) -> DataFrame:
    return _change(jobs, (F.col("id") == job_id) & (F.col("status") == "pending"), status=F.lit("cancelled"))


def cancel_removal(jobs: DataFrame, fingerprint: str) -> DataFrame:
    """All copies' removals or none: none if one runs already."""
    own = (F.col("kind") == "remove") & (F.col("fingerprint") == fingerprint)
    runs = jobs.where(own).agg(F.coalesce(F.bool_or(F.col("status") == "running"), F.lit(False)).alias("_runs"))
    out = jobs.join(F.broadcast(runs))
    return _change(out, own & ~F.col("_runs") & (F.col("status") == "pending"), status=F.lit("cancelled")).drop("_runs")


def hide_finished(jobs: DataFrame) -> DataFrame:
    return _change(jobs, F.col("status").isin(FINISHED), hidden=F.lit(True))


def status_counts(jobs: DataFrame, include_hidden: bool = True) -> DataFrame:
    rows = jobs if include_hidden else jobs.where(~F.coalesce("hidden", F.lit(False)))
    names = jobs.sparkSession.createDataFrame([(s,) for s in JOB_STATUSES], "status string")
    return names.join(rows.groupBy("status").agg(F.count(F.lit(1)).alias("n")), "status", "left").na.fill(0)


def enqueue(jobs: DataFrame, desired: DataFrame, new: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """new: (id, path, fingerprint, kind, payload_json, created_at).

    One row a (path, version): a finished row reopens if forced or if the
    desired version changed; a cancelled version isn't added again unforced.
    """
    key = ["path", "fingerprint"]
    want = desired.select("path", F.col("fingerprint").alias("_desired"))
    old = jobs.join(new.select(*key).withColumn("_asked", F.lit(True)), key, "left").join(want, "path", "left")
    moved = ~F.col("_desired").eqNullSafe(F.col("fingerprint"))
    reopen = F.coalesce("_asked", F.lit(False)) & ~F.col("status").isin("pending", "running") & (F.lit(force) | (moved & (F.col("status") != "cancelled")))
    old = _change(old, reopen, status=F.lit("pending"), attempts=F.lit(0), available_at=F.lit(0.0), error=F.lit(None).cast("string"), hidden=F.lit(False)).drop("_asked", "_desired")
    fresh = new.join(jobs, key, "left_anti").withColumn("status", F.lit("pending")).withColumn("attempts", F.lit(0)).withColumn("available_at", F.lit(0.0)).withColumn("hidden", F.lit(False))
    wanted = desired.join(new, "path", "left_anti").unionByName(new.groupBy("path").agg(F.max_by("fingerprint", "id").alias("fingerprint")))
    return old.unionByName(fresh, allowMissingColumns=True), wanted


def queue_fold(events: DataFrame, max_attempts: int = ATTEMPTS, delay: float = DELAY) -> DataFrame:
    """Last state of each key from its log (key, ts, seq, outcome).

    Outcome ``error`` fails an attempt, ``done`` finishes.  Attempts since the
    last success and the next time follow from windows; no row-wise fold.
    """
    order = Window.partitionBy("key").orderBy("ts", "seq")
    rows = events.withColumn("epoch", F.sum((F.col("outcome") == "done").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("epoch", F.coalesce("epoch", F.lit(0)))
    g = rows.groupBy("key").agg(F.max_by("epoch", F.struct("ts", "seq")).alias("epoch"), F.max_by("outcome", F.struct("ts", "seq")).alias("last"), F.max("ts").alias("ts"))
    errors = rows.groupBy("key", "epoch").agg(F.count_if(F.col("outcome") == "error").alias("attempts"))
    out = g.join(errors, ["key", "epoch"])
    status = F.when(F.col("last") == "done", "done").when(F.col("attempts") >= max_attempts, "failed").otherwise("pending")
    wait = F.when((status == "pending") & (F.col("attempts") > 0), backoff(F.col("attempts"), delay))
    return out.select("key", status.alias("status"), "attempts", wait.alias("delay"), "ts")


def alive(heartbeats: DataFrame, now: float, stale: float = STALE_WORKER) -> DataFrame:
    return heartbeats.groupBy("name").agg(F.max("ts").alias("ts")).withColumn("alive", F.lit(now) - F.col("ts") < stale)


# --- accounting -----------------------------------------------------------


def usage_rows(events: DataFrame) -> DataFrame:
    """One row a call id: a final status beats started; re-delivery is harmless.

    Cost = (in * rate_in + out * rate_out) / 1e6 in exact decimals; null for
    local calls, missing rates and missing counts.
    """
    last = F.struct(F.when(F.col("status") == "started", 0).otherwise(1).alias("final"), "seq")
    names = [c for c in events.columns if c not in ("id", "seq")]
    rows = events.groupBy("id").agg(F.max_by(F.struct(*names), last).alias("e")).select("id", "e.*")
    # scales add up to 15 within 38 digits, so no step rounds
    d = lambda c: F.col(c).cast("decimal(12,0)")
    r = lambda c: F.col(c).cast("decimal(14,9)")
    cost = ((d("tokens_in") * r("rate_in") + d("tokens_out") * r("rate_out")) * F.lit(Decimal("0.000001")).cast("decimal(7,6)")).cast("decimal(38,18)")
    return rows.withColumn("estimated_cost", F.when(F.col("external"), cost))


def tokens_since(usage: DataFrame, since: Column) -> DataFrame:
    return usage.where(F.col("created_at") >= since).agg(F.coalesce(F.sum(F.coalesce("tokens_in", F.lit(0)) + F.coalesce("tokens_out", F.lit(0))), F.lit(0)).alias("tokens"))


def usage_summary(usage: DataFrame, since: float | None = None, until: float | None = None) -> DataFrame:
    if since is not None:
        usage = usage.where(F.col("created_at") >= since)
    if until is not None:
        usage = usage.where(F.col("created_at") < until)
    g = usage.groupBy("model", "currency", "external")
    return g.agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"), F.count_if(F.col("status") == "error").alias("errors"), F.sum("estimated_cost").cast("string").alias("cost")).orderBy("model", "currency", "external")


def daily_budget(usage: DataFrame, limit: int) -> DataFrame:
    """UTC days with tokens, the running month total and whether the day is over."""
    day = F.date_trunc("DAY", F.timestamp_seconds("created_at")).cast("date")
    d = usage.groupBy(day.alias("day")).agg(F.sum(F.coalesce("tokens_in", F.lit(0)) + F.coalesce("tokens_out", F.lit(0))).alias("tokens"))
    month = Window.partitionBy(F.trunc("day", "MM")).orderBy("day")
    return d.withColumn("month_tokens", F.sum("tokens").over(month)).withColumn("over_limit", F.col("tokens") >= limit)


# --- conversations and documents ------------------------------------------


def recent_messages(messages: DataFrame, limit: int = 12) -> DataFrame:
    """The last ``limit`` messages of each conversation, in order."""
    last = Window.partitionBy("conversation_id").orderBy(F.col("seq").desc())
    return messages.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= limit).drop("_n").orderBy("conversation_id", "seq")


def like_escape(q: str) -> str:
    return q.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def search_titles(rows: DataFrame, q: str, column: str = "title") -> DataFrame:
    """Literal, case-insensitive substring."""
    return rows.where(F.col(column).ilike(f"%{like_escape(q)}%"))


def rename(conversations: DataFrame, conversation_id: str, title: str) -> DataFrame:
    return _change(conversations, F.col("id") == conversation_id, title=F.left(F.trim(F.lit(title)), F.lit(200)))


def title_if_empty(conversations: DataFrame, firsts: DataFrame) -> DataFrame:
    """firsts: (id, content): a conversation without title takes its first 60 characters."""
    j = conversations.join(firsts.select("id", F.left(F.trim("content"), F.lit(60)).alias("_t")), "id", "left")
    return j.withColumn("title", F.when(F.coalesce("title", F.lit("")) == "", F.col("_t")).otherwise(F.col("title"))).drop("_t")


def delete_conversation(conversations: DataFrame, messages: DataFrame, conversation_id: str) -> tuple[DataFrame, DataFrame]:
    return conversations.where(F.col("id") != conversation_id), messages.where(F.col("conversation_id") != conversation_id)


def corpus(files: DataFrame, uploads: DataFrame) -> DataFrame:
    """Queued uploads that aren't registered yet, by name, then files by path."""
    waiting = uploads.join(files.select("doc_id"), "doc_id", "left_anti").select("doc_id", "path", F.lit("queued").alias("status"), F.col("name").alias("label"), F.lit(0).alias("part"))
    named = files.join(uploads.select("doc_id", F.col("name").alias("_n"), F.col("path").alias("_p")), "doc_id", "left")
    label = F.coalesce("_n", F.nullif(F.regexp_extract("path", "([^/]*)$", 1), F.lit("")), "doc_id")
    return waiting.unionByName(named.select("doc_id", "path", "status", label.alias("label"), F.lit(1).alias("part"))).orderBy("part", F.when(F.col("part") == 0, F.col("label")).otherwise(F.col("path")), "doc_id")


def stats(files: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    from .graph import counts

    by_status = files.groupBy("status").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("documents:"), "status").alias("label"), "n")
    return counts(tables).unionByName(by_status)


def history(messages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Messages whose sources say if their chunk still exists."""
    source = "array<struct<number:int,kind:string,ref:string,snippet:string>>"
    rows = messages.withColumn("_s", F.from_json("sources", source))
    flat = rows.select("id", F.posexplode("_s").alias("pos", "s")).join(chunks.select(F.col("chunk_id").alias("_ref"), F.lit(True).alias("_there")), F.col("s.ref") == F.col("_ref"), "left")
    flat = flat.withColumn("s", F.col("s").withField("available", F.coalesce("_there", F.lit(False))))
    back = flat.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias("sources"))
    return rows.drop("sources", "_s").join(back, "id", "left")


def pending_path(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status") == "pending").groupBy("path").agg(F.count(F.lit(1)).alias("n"))


# --- stage sessions and ingest rules --------------------------------------


def stage_sessions(steps: DataFrame) -> DataFrame:
    """Runs of equal names in order: key, name, begin, end, n, tokens."""
    order = Window.partitionBy("key").orderBy("ts", "seq")
    changed = (~F.col("name").eqNullSafe(F.lag("name").over(order))).cast("int")
    rows = steps.withColumn("run", F.sum(changed).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("key", "run", "name").agg(F.min("ts").alias("begin"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))


def ingest_plan(found: DataFrame, files: DataFrame, retry_failed: bool = False) -> DataFrame:
    """found: (path, doc_id); what happens to each file: add, change, skip, retry."""
    f = files.select("path", F.col("doc_id").alias("old_id"), "status")
    j = found.join(f, "path", "left")
    action = F.when(F.col("old_id").isNull(), "add").when(F.col("old_id") != F.col("doc_id"), "change").when(F.col("status") == "done", "skip").when((F.col("status") == "failed") & ~F.lit(retry_failed), "failed").otherwise("resume")
    return j.select("path", "doc_id", "old_id", action.alias("action"))


def select_removals(files: DataFrame, paths: list[str], present: DataFrame | None = None) -> DataFrame:
    """Registered files at or below the paths, or with ``present``, missing ones;
    a document that lives on at another path keeps its data (``survivor``)."""
    if present is not None:
        chosen = files.join(present.select("path"), "path", "left_anti")
    else:
        hit = F.lit(False)
        for p in paths:
            hit = hit | (F.col("path") == p) | F.startswith("path", F.lit(p.rstrip("/") + "/"))
        chosen = files.where(hit)
    left = files.join(chosen.select("path"), "path", "left_anti").groupBy("doc_id").agg(F.min("path").alias("survivor"))
    return chosen.select("doc_id", "path").join(left, "doc_id", "left")


def corpus_fingerprint(rows: DataFrame, *columns: str) -> DataFrame:
    """One hash of a table's rows in any order: sums of the parts of row hashes,
    which combine within tasks, so nothing is gathered or sorted."""
    parts = rows.select(F.sha2(F.concat_ws("\u0001", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in columns)).cast("binary"), 256).alias("h"))
    number = lambda k: F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")
    sums = parts.agg(F.count(F.lit(1)).alias("rows"), *(F.coalesce(F.sum(number(k)), F.lit(0)).alias(f"s{k}") for k in range(4)))
    return sums.select(F.sha2(F.concat_ws(":", "rows", *(F.col(f"s{k}").cast("string") for k in range(4))).cast("binary"), 256).alias("fingerprint"), "rows")


def parse_payload(rows: DataFrame, column: str, schema: str) -> DataFrame:
    return rows.withColumn(column, F.from_json(column, schema))


def process_one(jobs: list[dict], handler, now: float, max_attempts: int = ATTEMPTS, delay: float = DELAY) -> tuple[list[dict], str]:
    """Driver-side worker step over a small claimed set: run, then classify."""
    waiting = sorted((j for j in jobs if j["status"] == "pending" and j["available_at"] <= now and j["attempts"] < max_attempts), key=lambda j: j["id"])
    if not waiting:
        return jobs, "idle"
    job = waiting[0]
    job |= {"status": "running", "attempts": job["attempts"] + 1}
    try:
        handler(job)
        job["status"] = "done"
    except TimeoutError as e:
        job |= {"status": "pending", "error": f"TimeoutError: {e}", "available_at": now + delay}
    except ConnectionError as e:  # transient: the attempt is given back
        job |= {"status": "pending", "attempts": job["attempts"] - 1, "error": f"{type(e).__name__}: {e}", "available_at": now + delay}
    except Exception as e:
        over = job["attempts"] >= max_attempts
        job |= {"status": "failed" if over else "pending", "error": f"{type(e).__name__}: {e}", "available_at": now + min(delay * 2 ** min(job["attempts"] - 1, 16), DELAY_CAP)}
    return jobs, job["status"]


def jsonl(pdf: pd.DataFrame) -> str:
    return "".join(json.dumps(r, ensure_ascii=False, sort_keys=True) + "\n" for r in pdf.to_dict("records"))
