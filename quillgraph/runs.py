"""Runs around the engine: evaluation by a fixed plan, measured ingest, call accounting."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .engine import Engine
from .functions.text import canonical_json, fingerprint, row_fingerprint
from .operators import evaluate, tables
from .operators.analytics import cut
from .schema import METRICS, MODES
from .sources import files

CONFIG_SECTIONS = ["embedding", "extraction", "retrieval", "answer", "wiki"]


def config_hash(settings: dict) -> str:
    """Twelve hex digits over the sections that change answers."""
    return hashlib.sha1(canonical_json({s: settings.get(s) for s in CONFIG_SECTIONS}).encode()).hexdigest()[:12]


class PlanChanged(RuntimeError):
    """A run's folder holds the plan of another run."""


class EvaluationRun:
    """Questions x modes answered and judged into append-only logs.

    The manifest is written once and never changes; a run with another plan is
    refused.  Answering and scoring only do what the logs lack, so a run that
    stopped goes on where it was.
    """

    def __init__(self, engine: Engine, folder: str, questions: DataFrame, modes: list[str] = MODES, k: int = 8, settings: dict | None = None):
        self.engine, self.spark, self.folder, self.modes, self.k = engine, engine.spark, folder.rstrip("/"), list(modes), k
        self.questions = cut(evaluate.validate_questions(questions))
        corpus = {r.table: r.fingerprint for r in engine.snapshot().collect()}  # a row a table
        rows = tables.corpus_fingerprint(self.questions, *sorted(self.questions.columns)).first()
        self.plan = {"questions": rows.fingerprint, "n": rows.rows, "modes": self.modes, "k": k, "config": config_hash(settings or {}), "corpus": corpus}
        self.ensure_manifest()

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def ensure_manifest(self) -> dict:
        want = canonical_json(self.plan)
        if self._exists("manifest"):
            have = self.spark.read.text(f"{self.folder}/manifest").first()[0]
            if have != want:
                raise PlanChanged(f"{self.folder} holds another plan: {fingerprint(json.loads(have))[:12]}")
        else:
            self.spark.createDataFrame([(want,)], "value string").coalesce(1).write.text(f"{self.folder}/manifest")
        return self.plan

    def log(self, name: str, schema: str) -> DataFrame:
        schema += ", seq long"
        return self.spark.read.schema(schema).json(f"{self.folder}/{name}") if self._exists(name) else self.spark.createDataFrame([], schema)

    ANSWER = files.ANSWER + ", answer_fingerprint string"

    def answers(self) -> DataFrame:
        return evaluate.planned(self.questions, self.log("answers", self.ANSWER), self.modes)

    def run_answers(self) -> int:
        """Answer what isn't ok yet; an empty answer is an error.  Rows done."""
        todo = cut(evaluate.todo(self.answers()).select("id", "question", "mode"))
        done = 0
        for mode in self.modes:
            rows = todo.where(F.col("mode") == mode).withColumn("query_id", F.xxhash64("id"))
            if rows.isEmpty():
                continue
            began = time.time()
            got = cut(self.engine.ask(rows.select("query_id", "question"), mode, self.k).drop("question", "mode"))
            n = got.count()
            spent = int(1000 * (time.time() - began) / max(1, n))
            text = F.coalesce(F.trim("answer"), F.lit(""))
            status = F.when(F.col("error").isNotNull() | (text == ""), "error").otherwise("ok")
            contexts = F.transform(F.coalesce("sources", F.array().cast(dict(got.dtypes)["sources"])), lambda s: s["snippet"])
            out = rows.join(got, "query_id").select("id", "mode", "question", text.alias("text"), contexts.alias("contexts"), status.alias("status"), F.lit(spent).cast("long").alias("latency_ms"), F.lit(None).cast("long").alias("tokens_in"), F.lit(None).cast("long").alias("tokens_out"), F.lit(None).cast("long").alias("context_tokens"), row_fingerprint(text, contexts).alias("answer_fingerprint"), F.lit(time.time_ns()).alias("seq"))
            files.append_jsonl(out, f"{self.folder}/answers")
            done += n
        return done

    def score_run(self, judge, metrics: list[str] = METRICS) -> int:
        """Judge what has no ok or skipped score of its present answer.

        ``judge`` is a column function (metric, question, answer, contexts,
        reference) -> struct<value,error>.
        """
        rows = evaluate.unscored(self.answers(), self.log("scores", files.SCORE), metrics)
        rows = cut(evaluate.skip_reason(rows))
        asked = rows.where("skip_reason IS NULL").withColumn("_j", judge(F.col("metric"), F.col("question"), F.col("text"), F.col("contexts"), F.col("reference")))
        asked = asked.withColumn("value", F.col("_j.value")).withColumn("error", F.col("_j.error")).drop("_j")
        skipped = rows.where("skip_reason IS NOT NULL").withColumn("value", F.lit(None).cast("double")).withColumn("error", F.lit(None).cast("string"))
        out = cut(evaluate.score_status(asked.unionByName(skipped)).select("id", "mode", "metric", F.col("score_status").alias("status"), "value", "answer_fingerprint", F.col("skip_reason").alias("reason"), "error", F.lit(time.time_ns()).alias("seq")))
        files.append_jsonl(out, f"{self.folder}/scores")
        return out.count()

    def report(self, metrics: list[str] = METRICS) -> DataFrame:
        return evaluate.summary(evaluate.details(self.answers(), self.log("scores", files.SCORE), metrics))


def measured_ingest(engine: Engine, paths: list[str], log: str, phase: str | None = None, **options) -> dict:
    """Ingest, and one row of the processing log for the attempt, also if it fails."""
    before = {r.table: r.fingerprint for r in engine.snapshot().collect()}
    known = engine.read("files").limit(1).count() > 0
    row = {"id": uuid.uuid4().hex, "phase": phase or ("update" if known else "build"), "status": "ok", "scope": ",".join(paths)}
    began = time.time()
    try:
        engine.ingest(paths, **options)
    except BaseException as e:
        row["status"] = f"{type(e).__name__}"
        raise
    finally:
        after = {r.table: r.fingerprint for r in engine.snapshot().collect()}
        spent = int(1000 * (time.time() - began))
        last = (row["id"], row["phase"], row["status"], row["scope"], spent, None, None, ("corpus", fingerprint(before)), ("corpus", fingerprint(after)), [])
        files.append_jsonl(engine.spark.createDataFrame([last], files.PROCESSING), log)
    return row | {"duration_ms": spent, "changed": before != after}


# --- calls to models --------------------------------------------------------


def wait_before(attempt: int, *, retry_after: float | None = None, base: float = 1.0, most: float = 60.0) -> float:
    """Seconds before attempt ``attempt`` + 1: doubling, never less than asked for."""
    return max(min(base * 2 ** (attempt - 1), most), retry_after or 0.0)


def give_up(attempt: int, spent: float, *, rate_limited: bool = False, attempts: int = 5, deadline: float = 600.0) -> bool:
    """Whether no further attempt is made; waiting for a rate is only ended by time."""
    return spent >= deadline or attempt >= attempts and not rate_limited


class Usage:
    """Calls of a scope: a started and a final event each, and their sums."""

    def __init__(self):
        self.events: list[tuple] = []
        self.tokens_in = self.tokens_out = 0

    def call(self, model: str, operation: str, external: bool) -> str:
        ident = uuid.uuid4().hex
        self.events.append((ident, model, operation, time.time(), external, "started", None, None, 0))
        return ident

    def final(self, ident: str, status: str, tokens_in: int | None, tokens_out: int | None) -> None:
        first = next(e for e in self.events if e[0] == ident)
        self.events.append((*first[:5], status, tokens_in, tokens_out, 1))
        self.tokens_in += tokens_in or 0
        self.tokens_out += tokens_out or 0


EVENT = "id string, model string, operation string, created_at double, external boolean, status string, tokens_in long, tokens_out long, seq int"


@contextmanager
def usage_scope(engine: Engine) -> Iterator[Usage]:
    """Counts the calls made inside and records their rows, also after an error."""
    usage = Usage()
    try:
        yield usage
    finally:
        if usage.events:
            e = engine.spark.createDataFrame(usage.events, EVENT).withColumn("currency", F.lit("USD"))
            rate = lambda c: F.lit(None).cast("decimal(38,18)").alias(c)
            rows = tables.usage_rows(e.select("*", rate("rate_in"), rate("rate_out"))).withColumn("job_id", F.lit(None).cast("long"))
            engine.store.merge({"llm_usage": (rows.select("id"), rows)}, base=False)


class OverBudget(RuntimeError):
    pass


def check_budget(engine: Engine, limit: int, now: float | None = None) -> int:
    """Tokens of the UTC day; raises where they reach ``limit``."""
    since = (now or time.time()) // 86_400 * 86_400
    used = tables.tokens_since(engine.read("llm_usage"), F.lit(float(since))).first()[0]
    if used >= limit:
        raise OverBudget(f"{used} of {limit} tokens are used today")
    return used
