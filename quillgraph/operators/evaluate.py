"""Evaluation reports over append-only logs of answers and scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import METRICS, MODES

#: Resamples, and the share of them that lies below and above an interval.
RESAMPLES, TAIL = 1000, 0.025
NEEDS_REFERENCE = ["context_precision_with_reference", "context_recall", "factual_correctness"]
NEEDS_CONTEXT = ["faithfulness", "context_precision_with_reference", "context_recall"]


def latest_records(log: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The last record of each key; combined within tasks before the exchange."""
    names = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*names), seq).alias("_r")).select(*keys, "_r.*")


def validate_questions(rows: DataFrame) -> DataFrame:
    """Trimmed questions; raises on empty or repeated ids and bad lengths."""
    n = Window.partitionBy("id")
    q = F.trim("question")
    bad = (F.coalesce(F.trim("id"), F.lit("")) == "") | (F.count(F.lit(1)).over(n) > 1) | ~F.length(q).between(1, 16000) | q.isNull()
    return rows.withColumn("question", F.when(bad, F.raise_error(F.concat(F.lit("bad question: "), F.coalesce("id", F.lit("null"))))).otherwise(q))


def planned(questions: DataFrame, answers: DataFrame, modes: list[str] = MODES) -> DataFrame:
    """questions x modes with the latest answer; without one: missing."""
    m = questions.sparkSession.createDataFrame(list(enumerate(modes)), "mode_pos int, mode string")
    plan = questions.join(F.broadcast(m))  # a handful of modes
    last = latest_records(answers, ["id", "mode"]).drop("question")
    return plan.join(last, ["id", "mode"], "left").withColumn("status", F.coalesce("status", F.lit("missing")))


def todo(plan: DataFrame) -> DataFrame:
    return plan.where("status <> 'ok'")


def unscored(plan: DataFrame, scores: DataFrame, metrics: list[str] = METRICS) -> DataFrame:
    """(id, mode, metric) without an ok or skipped score of the same answer."""
    m = plan.sparkSession.createDataFrame([(x,) for x in metrics], "metric string")
    done = latest_records(scores, ["id", "mode", "metric"]).where(F.col("status").isin("ok", "skipped")).select("id", "mode", "metric", "answer_fingerprint")
    return plan.join(F.broadcast(m)).join(done, ["id", "mode", "metric", "answer_fingerprint"], "left_anti")


def skip_reason(rows: DataFrame) -> DataFrame:
    reason = (
        F.when(F.col("status") != "ok", "inference_failed_or_missing")
        .when(F.col("metric").isin(NEEDS_REFERENCE) & F.col("reference").isNull(), "no_reference")
        .when(F.col("metric").isin(NEEDS_CONTEXT) & (F.coalesce(F.size("contexts"), F.lit(0)) < 1), "empty_context")
    )
    return rows.withColumn("skip_reason", reason)


def score_status(rows: DataFrame) -> DataFrame:
    """Judge values to statuses: skipped, error, undefined (not finite), ok."""
    bad = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    status = F.when(F.col("skip_reason").isNotNull(), "skipped").when(F.col("error").isNotNull(), "error").when(bad, "undefined").otherwise("ok")
    return rows.withColumn("score_status", status).withColumn("value", F.when(status == "ok", F.col("value")))


def details(plan: DataFrame, scores: DataFrame, metrics: list[str] = METRICS) -> DataFrame:
    """Answers x metrics; a score of another answer counts as missing."""
    m = plan.sparkSession.createDataFrame(list(enumerate(metrics)), "metric_pos int, metric string")
    s = latest_records(scores, ["id", "mode", "metric"]).select("id", "mode", "metric", F.col("answer_fingerprint").alias("_f"), F.col("status").alias("_s"), "value")
    d = plan.join(F.broadcast(m)).join(s, ["id", "mode", "metric"], "left")
    same = F.coalesce(F.col("_f") == F.col("answer_fingerprint"), F.lit(False))
    return d.withColumn("score_status", F.when(same, F.col("_s")).otherwise("missing")).withColumn("value", F.when(same & (F.col("_s") == "ok"), F.col("value"))).drop("_f", "_s")


def summary(rows: DataFrame) -> DataFrame:
    """mode x metric: mean of ok scores, counts of statuses, latency, tokens."""
    g = rows.groupBy("mode", "metric")
    ok = F.col("status") == "ok"
    return g.agg(
        F.count(F.lit(1)).alias("planned"), F.round(F.avg("value"), 6).alias("mean"),
        *(F.count_if(F.col("score_status") == s).alias(s) for s in ("ok", "skipped", "undefined", "error", "missing")),
        F.count_if(ok).alias("answers_ok"), F.count_if(F.col("status") == "missing").alias("answers_missing"), F.count_if(~F.col("status").isin("ok", "missing")).alias("answers_error"),
        F.round(F.avg(F.when(ok, F.coalesce("latency_ms", F.lit(0)))), 6).alias("latency_ms"),
        F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"),
    )


def _deltas(rows: DataFrame) -> DataFrame:
    """mode_a, mode_b, metric, id, d: B - A of questions that are ok in both modes."""
    ok = rows.where("score_status = 'ok'").select("id", "mode", "mode_pos", "metric", "value")
    a = ok.select("id", "metric", F.col("mode").alias("mode_a"), F.col("mode_pos").alias("pa"), F.col("value").alias("va"))
    b = ok.select("id", "metric", F.col("mode").alias("mode_b"), F.col("mode_pos").alias("pb"), F.col("value").alias("vb"))
    return a.join(b, ["id", "metric"]).where("pa < pb").select("mode_a", "mode_b", "metric", "id", (F.col("vb") - F.col("va")).alias("d"))


def paired(rows: DataFrame) -> DataFrame:
    """For each mode pair and metric: questions ok in both and mean of B - A."""
    return _deltas(rows).groupBy("mode_a", "mode_b", "metric").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("d"), 6).alias("mean_delta"))


#: 32-bit numbers from which on a Poisson variable of mean 1 is over 0, 1, 2, ...
POISSON = [math.floor(2**32 * math.exp(-1) * sum(1 / math.factorial(k) for k in range(n + 1))) for n in range(12)]


def poisson_weights(key: Column, block: Column) -> Column:
    """Weights of a key in the four resamples of a block, from one keyed digest."""
    digest = F.md5(F.encode(F.concat(key, F.lit(":"), block.cast("string")), "UTF-8"))
    drawn = [F.conv(F.substring(digest, 8 * j + 1, 8), 16, 10).cast("long") for j in range(4)]
    return F.array(*(sum(((u >= t).cast("int") for t in POISSON), F.lit(0)) for u in drawn))


def intervals(rows: DataFrame, resamples: int = RESAMPLES) -> DataFrame:
    """mode_a, mode_b, metric, pairs, low, high: bootstrap interval of the mean delta.

    Poisson bootstrap: a question's weight in a resample follows from a hash of both,
    so a resample's mean is a ratio of two plain sums, summed in the tasks first, and
    all modes and metrics weigh a question alike.  Only the ``resamples`` means of a
    mode pair and metric are sorted.  Fewer than two pairs give null; resamples in
    which all weights are zero are left out.
    """
    deltas = _deltas(rows)
    by = ["mode_a", "mode_b", "metric"]
    pairs = deltas.groupBy(*by).agg(F.count(F.lit(1)).alias("pairs"))
    blocks = deltas.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(resamples // 4 - 1))))
    drawn = blocks.select(*by, "d", "block", F.posexplode(poisson_weights(F.col("id"), F.col("block"))).alias("j", "w")).where("w > 0")
    means = drawn.groupBy(*by, (4 * F.col("block") + F.col("j")).alias("r")).agg((F.sum(F.col("w") * F.col("d")) / F.sum("w")).alias("mean"))
    ends = means.groupBy(*by).agg(F.array_sort(F.collect_list("mean")).alias("m"))
    n = F.size("m")
    at = lambda place: F.round(F.element_at("m", F.greatest(F.lit(1), place.cast("int"))), 9)
    out = pairs.join(ends, by, "left")
    enough = F.col("pairs") >= 2
    return out.select(*by, "pairs", F.when(enough, at(F.floor(n * TAIL))).alias("low"), F.when(enough, at(F.ceil(n * (1 - TAIL)))).alias("high"))


def by_category(rows: DataFrame) -> DataFrame:
    c = F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit("unclassified"))
    return rows.groupBy(c.alias("category"), "mode", "metric").agg(F.count(F.lit(1)).alias("planned"), F.count_if(F.col("score_status") == "ok").alias("ok"), F.round(F.avg("value"), 6).alias("mean"), F.count_if(F.col("score_status") != "ok").alias("not_scored"))


def processing_costs(rows: DataFrame) -> DataFrame:
    """phase: attempts, failures, time and tokens (unknown if any is null)."""
    known = lambda c: F.when(F.bool_and(F.col(c).isNotNull()), F.sum(c))
    return rows.groupBy("phase").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("status") != "ok").alias("failed"), F.sum("duration_ms").alias("duration_ms"), known("tokens_in").alias("tokens_in"), known("tokens_out").alias("tokens_out"))


def stage_costs(rows: DataFrame) -> DataFrame:
    s = rows.select("phase", F.explode("stages").alias("s"))
    return s.groupBy("phase", "s.stage").agg(F.sum("s.duration_ms").alias("duration_ms"), F.sum("s.completed").alias("completed"), F.sum("s.failed").alias("failed"))


def compare_log(rows: DataFrame) -> DataFrame:
    """Cited sources of each row of the comparison log."""
    return rows.select("ts", "question", "mode", F.size(F.filter("sources", lambda s: s["cited"])).alias("cited"), "latency_ms")
