"""Catalogue queries over queue, accounting, chat and evaluation tables, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, tables
from ..session import load
from ..streaming import jobs

Q, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


TYPES = ["click", "error", "purchase", "signup", "view"]


def events(spark, sf):
    return load(spark, sf, "events")


@query(f"SELECT CAST(user_id % 10 AS BIGINT) AS stage, {', '.join(f'count(*) FILTER (WHERE event_type = {t!r}) AS {t}' for t in TYPES)} FROM events GROUP BY 1")
def stage_summary_pivot(spark, sf):
    return tables.stage_summary(events(spark, sf).withColumn("stage", F.col("user_id") % 10), TYPES, status="event_type")


@query("SELECT 'user:' || user_id AS chunk_id, max_by(event_type, event_id) AS prompt_version, max_by(props, event_id) AS result_json, max(event_id) AS seq FROM events GROUP BY 1")
def latest_extraction(spark, sf):
    cache = events(spark, sf).select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("chunk_id"), F.col("event_type").alias("prompt_version"), F.lit("m").alias("model"), F.col("props").alias("result_json"), F.col("event_id").alias("seq"))
    return tables.latest_extraction(cache).drop("model")


_OUT = "CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'done' ELSE 'claim' END"


def outcomes(spark, sf):
    o = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "done").otherwise("claim")
    return events(spark, sf).select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), o.alias("outcome"))


@query(f"""WITH x AS (SELECT user_id AS key, ts, event_id AS seq, {_OUT} AS outcome FROM events),
 y AS (SELECT *, coalesce(sum(CASE WHEN outcome = 'done' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch,
   row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS back FROM x),
 l AS (SELECT * FROM y WHERE back = 1),
 a AS (SELECT key, epoch, count(*) FILTER (WHERE outcome = 'error') AS attempts FROM y GROUP BY ALL)
SELECT key, CASE WHEN outcome = 'done' THEN 'done' WHEN attempts >= 5 THEN 'failed' ELSE 'pending' END AS status, attempts,
  CASE WHEN outcome <> 'done' AND attempts BETWEEN 1 AND 4 THEN least(30 * pow(2.0, least(attempts - 1, 16)), 3600) END AS delay, ts FROM l JOIN a USING (key, epoch)""")  # fmt: skip
def queue_fold(spark, sf):
    return tables.queue_fold(outcomes(spark, sf))


@query("SELECT event_id, CAST(1 + event_id % 20 AS BIGINT) AS attempts, least(30 * pow(2.0, least(event_id % 20, 16)), 3600) AS delay FROM events")
def backoff_delays(spark, sf):
    e = events(spark, sf).select("event_id", (F.lit(1) + F.col("event_id") % 20).alias("attempts"))
    return e.withColumn("delay", tables.backoff(F.col("attempts")))


def usage(spark, sf):
    """Events as model calls: errors fail, clicks run locally, k is the input."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = events(spark, sf).select(
        F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("model"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), F.lit(1).alias("seq"),
        F.unix_timestamp("ts").cast("double").alias("created_at"), (F.col("event_type") != "click").alias("external"), k.alias("tokens_in"), F.floor("value").cast("long").alias("tokens_out"), F.lit("USD").alias("currency"),
        F.lit("0.15").cast("decimal(38,18)").alias("rate_in"), F.lit("0.6").cast("decimal(38,18)").alias("rate_out"),
    )
    started = e.withColumn("status", F.lit("started")).withColumn("seq", F.lit(0)).withColumn("tokens_in", F.lit(None).cast("long")).withColumn("tokens_out", F.lit(None).cast("long"))
    return tables.usage_rows(e.unionByName(started).unionByName(e))  # started, final, and a re-delivery


_USE = "u AS (SELECT event_type AS model, event_type <> 'click' AS external, CAST(json_extract_string(props, '$.k') AS BIGINT) AS i, CAST(floor(value) AS BIGINT) AS o, CAST(date_trunc('day', ts) AS DATE) AS day FROM events)"


@query(f"""WITH {_USE} SELECT model, 'USD' AS currency, external, count(*) AS calls, CAST(sum(i) AS BIGINT) AS tokens_in, CAST(sum(o) AS BIGINT) AS tokens_out,
  count(*) FILTER (WHERE model = 'error') AS errors, CASE WHEN any_value(external) THEN CAST(CAST(sum(CAST(i * 15 + o * 60 AS DECIMAL(20,0))) AS DECIMAL(38,18)) / 100000000 AS DECIMAL(18,6)) END AS cost FROM u GROUP BY model, external""")  # fmt: skip
def llm_usage_summary(spark, sf):
    out = tables.usage_summary(usage(spark, sf))
    return out.withColumn("cost", F.col("cost").cast("decimal(18,6)"))


@query(f"""WITH {_USE}, d AS (SELECT day, CAST(sum(i + o) AS BIGINT) AS tokens FROM u GROUP BY 1)
SELECT day, tokens, CAST(sum(tokens) OVER (PARTITION BY date_trunc('month', day) ORDER BY day) AS BIGINT) AS month_tokens, tokens >= 20000 AS over_limit FROM d""")  # fmt: skip
def daily_budget(spark, sf):
    return tables.daily_budget(usage(spark, sf), 20000)


@query("""WITH x AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) OR row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 THEN 1 ELSE 0 END AS c FROM events),
 y AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM x)
SELECT user_id AS key, CAST(run AS BIGINT) AS run, event_type AS name, min(ts) AS begin, max(ts) AS "end", count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens FROM y GROUP BY ALL""")  # fmt: skip
def stage_sessions(spark, sf):
    e = events(spark, sf).select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("name"), F.get_json_object("props", "$.k").cast("long").alias("tokens"))
    return tables.stage_sessions(e)


@query("SELECT conv_id, count(*) AS hits, min(turn) AS first_turn FROM conversations WHERE contains(lower(text), 'that') GROUP BY 1")
def conversation_search(spark, sf):
    return tables.search_titles(load(spark, sf, "conversations"), "THAT", "text").groupBy("conv_id").agg(F.count(F.lit(1)).alias("hits"), F.min("turn").alias("first_turn"))


def eval_log(spark, sf):
    """Benchmark items as questions; labels as logged answers and scores of two
    modes: quality scores rag, toxic scores wiki; the last row of a key wins."""
    n = load(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"), F.when(F.col("item_id") % 3 == 0, "odd").alias("category"), F.lit("ref").alias("reference"))
    b = load(spark, sf, "labels").withColumn("id", F.col("doc_id").cast("string"))
    part = lambda mode, col: b.select("id", F.lit(mode).alias("mode"), F.col("doc_id").alias("seq"), F.col(col).alias("v"), (F.col("doc_id") % 100).alias("latency_ms"))
    rows = part("rag", "quality").unionByName(part("wiki", "toxic"))
    answers = rows.select("id", "mode", "seq", F.lit("q").alias("question"), F.when(F.col("latency_ms") < 90, "ok").otherwise("error").alias("status"), F.concat_ws("-", "id", "mode").alias("answer_fingerprint"), "latency_ms", F.lit(3).cast("long").alias("tokens_in"), F.lit(5).cast("long").alias("tokens_out"))
    scores = rows.where("latency_ms < 80").select("id", "mode", F.lit("faithfulness").alias("metric"), "seq", F.lit("ok").alias("status"), F.col("v").cast("double").alias("value"), F.concat_ws("-", "id", "mode").alias("answer_fingerprint"))
    return n, answers, scores


_EVAL = """b AS (SELECT CAST(item_id AS VARCHAR) AS id, CASE WHEN item_id % 3 = 0 THEN 'odd' END AS category FROM benchmark),
 md AS (SELECT * FROM (VALUES (0, 'rag'), (1, 'wiki')) t(mode_pos, mode)),
 lg AS (SELECT CAST(doc_id AS VARCHAR) AS id, mode, CASE mode WHEN 'rag' THEN quality ELSE toxic END AS v, doc_id % 100 AS lat FROM labels, md),
 pl AS (SELECT b.id, b.category, md.mode, md.mode_pos, CASE WHEN lg.id IS NULL THEN 'missing' WHEN lat < 90 THEN 'ok' ELSE 'error' END AS status, v, lat FROM b CROSS JOIN md LEFT JOIN lg ON lg.id = b.id AND lg.mode = md.mode),
 dt AS (SELECT *, CASE WHEN lat < 80 THEN 'ok' ELSE 'missing' END AS score_status, CASE WHEN lat < 80 THEN CAST(v AS DOUBLE) END AS value FROM pl)"""


@query(f"WITH {_EVAL} SELECT id, mode, status FROM pl")
def eval_plan(spark, sf):
    q, answers, _ = eval_log(spark, sf)
    return evaluate.planned(q, answers, ["rag", "wiki"]).select("id", "mode", "status")


def eval_details(spark, sf):
    q, answers, scores = eval_log(spark, sf)
    return evaluate.details(evaluate.planned(q, answers, ["rag", "wiki"]), scores, ["faithfulness"])


@query(f"""WITH {_EVAL} SELECT mode, 'faithfulness' AS metric, count(*) AS planned, round(avg(value), 6) AS mean, count(*) FILTER (WHERE score_status = 'ok') AS ok, 0::BIGINT AS skipped, 0::BIGINT AS undefined, 0::BIGINT AS error,
  count(*) FILTER (WHERE score_status = 'missing') AS missing, count(*) FILTER (WHERE status = 'ok') AS answers_ok, count(*) FILTER (WHERE status = 'missing') AS answers_missing, count(*) FILTER (WHERE status = 'error') AS answers_error,
  round(avg(lat) FILTER (WHERE status = 'ok'), 6) AS latency_ms, CAST(3 * count(*) FILTER (WHERE status <> 'missing') AS BIGINT) AS tokens_in, CAST(5 * count(*) FILTER (WHERE status <> 'missing') AS BIGINT) AS tokens_out FROM dt GROUP BY mode""")  # fmt: skip
def eval_summary(spark, sf):
    return evaluate.summary(eval_details(spark, sf))


@query(f"""WITH {_EVAL} SELECT x.mode AS mode_a, y.mode AS mode_b, 'faithfulness' AS metric, count(*) AS pairs, round(avg(y.value - x.value), 6) AS mean_delta
FROM dt x JOIN dt y ON x.id = y.id AND x.mode_pos < y.mode_pos WHERE x.score_status = 'ok' AND y.score_status = 'ok' GROUP BY ALL""")  # fmt: skip
def eval_paired(spark, sf):
    return evaluate.paired(eval_details(spark, sf))


_U = "CAST('0x' || substr(md5(id || ':' || block), CAST(8 * j + 1 AS BIGINT), 8) AS BIGINT)"
_WEIGHT = "(" + " + ".join(f"CASE WHEN u >= {t} THEN 1 ELSE 0 END" for t in evaluate.POISSON) + ")"


@query(f"""WITH {_EVAL}, dl AS (SELECT x.mode AS mode_a, y.mode AS mode_b, 'faithfulness' AS metric, x.id, y.value - x.value AS d
  FROM dt x JOIN dt y ON x.id = y.id AND x.mode_pos < y.mode_pos WHERE x.score_status = 'ok' AND y.score_status = 'ok'),
 un AS (SELECT *, {_U} AS u FROM dl, (SELECT unnest(range({evaluate.RESAMPLES // 4})) AS block), (SELECT unnest(range(4)) AS j)),
 wt AS (SELECT *, {_WEIGHT} AS w FROM un),
 mn AS (SELECT mode_a, mode_b, metric, 4 * block + j AS r, sum(w * d) / sum(w) AS mean FROM wt WHERE w > 0 GROUP BY ALL),
 en AS (SELECT mode_a, mode_b, metric, list(mean ORDER BY mean) AS m FROM mn GROUP BY ALL),
 pr AS (SELECT mode_a, mode_b, metric, count(*) AS pairs FROM dl GROUP BY ALL)
SELECT mode_a, mode_b, metric, pairs, CASE WHEN pairs >= 2 THEN round(m[greatest(1, CAST(floor(len(m) * {evaluate.TAIL}) AS INTEGER))], 9) END AS low,
  CASE WHEN pairs >= 2 THEN round(m[greatest(1, CAST(ceil(len(m) * {1 - evaluate.TAIL}) AS INTEGER))], 9) END AS high FROM pr LEFT JOIN en USING (mode_a, mode_b, metric)""")  # fmt: skip
def eval_bootstrap(spark, sf):
    return evaluate.intervals(eval_details(spark, sf))


@query(f"""WITH {_EVAL} SELECT coalesce(category, 'unclassified') AS category, mode, 'faithfulness' AS metric, count(*) AS planned, count(*) FILTER (WHERE score_status = 'ok') AS ok, round(avg(value), 6) AS mean, count(*) FILTER (WHERE score_status <> 'ok') AS not_scored FROM dt GROUP BY ALL""")
def eval_categories(spark, sf):
    return evaluate.by_category(eval_details(spark, sf))


@query("""SELECT event_type AS phase, count(*) AS attempts, count(*) FILTER (WHERE user_id % 7 = 0) AS failed, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS duration_ms,
  CASE WHEN event_type <> 'view' THEN CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) END AS tokens_in, CAST(count(*) AS BIGINT) AS tokens_out FROM events GROUP BY 1""")
def processing_costs(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    e = events(spark, sf).select(F.col("event_type").alias("phase"), F.when(F.col("user_id") % 7 == 0, "failed").otherwise("ok").alias("status"), F.floor("value").cast("long").alias("duration_ms"), F.when(~((F.col("event_type") == "view") & (F.col("event_id") % 2 == 0)), k).alias("tokens_in"), F.lit(1).cast("long").alias("tokens_out"))
    return evaluate.processing_costs(e)


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, sf):
    return jobs.tumbling(events(spark, sf))


@query("""WITH s AS (SELECT value, unnest(range(4)) AS k, time_bucket(INTERVAL '15 minutes', ts) AS b FROM events)
SELECT b - k * INTERVAL '15 minutes' AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY 1""")
def events_sliding(spark, sf):
    return jobs.sliding(events(spark, sf))


@query("""WITH x AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS c FROM events),
 y AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, count(*) AS n FROM y GROUP BY user_id, s""")
def events_session(spark, sf):
    return jobs.sessions(events(spark, sf))
