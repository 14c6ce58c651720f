"""Catalogue queries that put the text, wiki and source functions on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import models, text
from ..operators import chunking, wiki
from ..operators.analytics import cut
from ..session import load
from ..sources import files
from . import driver_tables as d

Q, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def docs(spark, sf):
    return load(spark, sf, "documents")


def md5(c):
    return F.md5(F.encode(c, "UTF-8"))


_NORM = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}+#]+', ' ', 'g'))"
_SLUG = "CASE WHEN w = '' THEN 'untitled' WHEN length(w) > 80 THEN rtrim(left(w, 71), '-') || '-' || left(sha1(w), 8) ELSE w END"


# --- identity and numbers -------------------------------------------------


@query(f"""WITH {d.ENTITIES}, x AS (SELECT entity_id, name FROM n UNION ALL SELECT entity_id || ':long', repeat(name || ' ', 9) FROM n),
 y AS (SELECT entity_id, replace(replace({_NORM.format('name')}, '#', 'sharp'), ' ', '-') AS w FROM x) SELECT entity_id, {_SLUG} AS slug FROM y""")  # fmt: skip
def name_slugs(spark, sf):
    e = d.named_entities(spark, sf).select("entity_id", "name")
    long = e.select(F.concat("entity_id", F.lit(":long")).alias("entity_id"), F.repeat(F.concat("name", F.lit(" ")), 9).alias("name"))
    return e.union(long).select("entity_id", text.slugify(F.col("name")).alias("slug"))


@query("SELECT doc_id, md5(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\\p{L}\\p{N}\\p{M}+#]+', ' ', 'g'))) AS normal FROM documents")
def normalized_names(spark, sf):
    return docs(spark, sf).select("doc_id", md5(text.normalize_name(F.col("text"))).alias("normal"))


@query("SELECT doc_id, sha256(CAST(to_json({'doc_id': doc_id, 'lang': lang, 'source': source, 'n_chars': n_chars}) AS VARCHAR)) AS fingerprint FROM documents")
def row_fingerprints(spark, sf):
    return docs(spark, sf).select("doc_id", text.row_fingerprint(F.col("doc_id"), F.col("lang"), F.col("source"), F.col("n_chars")).alias("fingerprint"))


@query("SELECT chunk_id, left(chunk_id, length(chunk_id) - 6) AS doc_id, CAST(right(chunk_id, 5) AS INTEGER) AS idx FROM (WITH " + d.CHUNKS + " SELECT chunk_id FROM c)")
def chunk_id_parts(spark, sf):
    doc_id, idx = text.split_chunk_id(F.col("chunk_id"))
    return d.chunks(spark, sf).select("chunk_id", doc_id.alias("doc_id"), idx.alias("idx"))


@query("""WITH x AS (SELECT vec_id, list_transform(embedding[1:16], lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
 y AS (SELECT vec_id, unnest(range(16)) AS pos, unnest(v) AS x, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM x) SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(x / n, 6) AS x FROM y""")
def truncated_vectors(spark, sf):
    v = load(spark, sf, "embeddings").select("vec_id", F.posexplode(text.truncate_normalize(F.col("embedding"), 16)).alias("pos", "x"))
    return v.withColumn("x", F.round("x", 6))


@query("SELECT event_id, date_trunc('day', ts) AS day FROM events")
def event_days(spark, sf):
    return load(spark, sf, "events").select("event_id", text.day_start(F.unix_timestamp("ts")).alias("day"))


@query("SELECT event_id, CASE WHEN event_type IN ('error', 'view') THEN NULL ELSE value END AS value FROM events")
def finite_values(spark, sf):
    raw = F.when(F.col("event_type") == "error", F.lit(float("nan"))).when(F.col("event_type") == "view", F.lit(float("-inf"))).otherwise(F.col("value"))
    return load(spark, sf, "events").select("event_id", text.finite(raw).alias("value"))


@query("""WITH b AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)
SELECT p_partkey, round(4 + sqrt((p_retailprice - lo) / (hi - lo)) * 24, 6) AS size FROM part, b""")
def node_sizes(spark, sf):
    p = load(spark, sf, "part")
    b = p.agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))  # one row
    return p.join(F.broadcast(b)).select("p_partkey", F.round(text.node_size(F.col("p_retailprice"), F.col("lo"), F.col("hi"), 4.0, 28.0), 6).alias("size"))


_WORDS = "list_filter(string_split_regex(replace(lower(text), 'ß', 'ss'), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')"


@query(f"""WITH w AS (SELECT doc_id, unnest({_WORDS}) AS t FROM documents), b AS (SELECT doc_id, ('0x' || right(md5(t), 2))::INTEGER % 64 AS bucket, count(*) AS n FROM w GROUP BY ALL)
SELECT doc_id, CAST(bucket AS INTEGER) AS bucket, round(CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS FLOAT) AS DOUBLE), 5) AS x FROM b""")  # fmt: skip
def hash_embeddings(spark, sf):
    """The default embedder on whole texts: the places that aren't 0."""
    v = docs(spark, sf).select("doc_id", F.posexplode(models.embed_column(models.HashEmbedder())("text")).alias("bucket", "x"))
    return v.where("x <> 0").withColumn("x", F.round(F.col("x").cast("double"), 5))


# --- texts ----------------------------------------------------------------

_ERROR = """'Bearer tok' || event_id || ', sk-' || user_id || ' at https://u:pw' || event_id || '@host/ api_key=' || user_id || '; {"password": "p' || event_id || '", "passwd":"x"} access_token=abc&key=zz sk-long_key-' || event_id || ' ' || repeat('x', CAST(event_id % 700 AS INTEGER))"""


@query(rf"""WITH x AS (SELECT event_id, event_type || ': ' || {_ERROR} AS m FROM events),
 a AS (SELECT event_id, regexp_replace(m, '(?i)\bbearer\s+[^\s"'',;]+', 'Bearer ***', 'g') AS m FROM x),
 b AS (SELECT event_id, regexp_replace(regexp_replace(m, '\bsk-[A-Za-z0-9_-]+', 'sk-***', 'g'), '(://)[^/\s:@]+:[^/\s@]+@', '\1***@', 'g') AS m FROM a),
 y AS (SELECT event_id, regexp_replace(m, '(?i)\b(api[_-]?key|access[_-]?token|token|password|passwd|secret|key)("?\s*[:=]\s*"?)[^\s"''&,;}}]+', '\1\2***', 'g') AS m FROM b)
SELECT event_id, CASE WHEN length(m) > 500 THEN left(m, 499) || '…' ELSE m END AS error FROM y""")  # fmt: skip
def safe_errors(spark, sf):
    e = load(spark, sf, "events")
    s = lambda c: F.col(c).cast("string")
    message = F.concat(F.lit("Bearer tok"), s("event_id"), F.lit(", sk-"), s("user_id"), F.lit(" at https://u:pw"), s("event_id"), F.lit("@host/ api_key="), s("user_id"), F.lit('; {"password": "p'), s("event_id"), F.lit('", "passwd":"x"} access_token=abc&key=zz sk-long_key-'), s("event_id"), F.lit(" "), F.repeat(F.lit("x"), (F.col("event_id") % 700).cast("int")))
    return e.select("event_id", text.safe_error(F.col("event_type"), message).alias("error"))


@query("SELECT doc_id, md5('title: ' || source || ' | text: ' || text) AS document, md5('task: find' || chr(10) || text) AS query FROM documents")
def model_inputs(spark, sf):
    t = F.col("text")
    return docs(spark, sf).select("doc_id", md5(text.format_document(t, F.col("source"), "title: {title} | text: {content}")).alias("document"), md5(text.format_query(t, "task: find\n{content}")).alias("query"))


@query(r"""WITH x AS (SELECT doc_id, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS a, length(regexp_replace(text, '[^\p{L}]|[A-Za-z]', '', 'g')) AS b FROM documents)
SELECT doc_id, a > 0 AND b > 0.3::DOUBLE * a AS needed FROM x""")
def translation_needs(spark, sf):
    return docs(spark, sf).select("doc_id", text.needs_translation(F.col("text")).alias("needed"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'document ' || doc_id || '.md' || CASE WHEN doc_id % 2 = 0 THEN ', p.' || (doc_id % 9) ELSE '' END
  WHEN 1 THEN 'wiki ' || lang ELSE 'entity ' || lang END AS label FROM documents""")
def block_labels(spark, sf):
    x = docs(spark, sf)
    kind = F.when(F.col("doc_id") % 3 == 0, "chunk").when(F.col("doc_id") % 3 == 1, "wiki").otherwise("entity")
    path = F.concat(F.lit("/corpus/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    page = F.when(F.col("doc_id") % 2 == 0, (F.col("doc_id") % 9).cast("int"))
    return x.select("doc_id", text.block_label(kind, path, page, F.col("lang")).alias("label"))


_REPLY = r"'<think>hidden {' || event_type || '}</think>' || chr(10) || '```json' || chr(10) || props || chr(10) || '``` '"


@query(rf"""WITH x AS (SELECT event_id, {_REPLY} AS r FROM events), y AS (SELECT event_id, trim(regexp_replace(r, '(?is)<think>.*?</think>', '', 'g'), ' ' || chr(10)) AS r FROM x)
SELECT event_id, r AS plain, regexp_extract(r, '(?s)(\{{.*\}})', 1) AS json FROM y""")  # fmt: skip
def model_replies(spark, sf):
    reply = F.concat(F.lit("<think>hidden {"), "event_type", F.lit("}</think>\n```json\n"), "props", F.lit("\n``` "))
    return load(spark, sf, "events").select("event_id", text.strip_think(reply).alias("plain"), text.clean_json(reply).alias("json"))


@query("""WITH x AS (SELECT doc_id, string_split(regexp_replace(text, '(that|the)', chr(1) || chr(2) || '\\1' || chr(1), 'gi'), chr(1)) AS p FROM documents),
 y AS (SELECT doc_id, list_filter(p, lambda s: s <> '' AND s <> chr(2)) AS p FROM x)
SELECT doc_id, len(p) AS parts, len(list_filter(p, lambda s: starts_with(s, chr(2)))) AS hits, md5(replace(array_to_string(p, '|'), chr(2), '')) AS joined FROM y""")
def highlighted_parts(spark, sf):
    parts = docs(spark, sf).select("doc_id", text.split_matches(F.col("text"), ["the", "that", ""]).alias("p"))
    return parts.select("doc_id", F.size("p").cast("long").alias("parts"), F.size(F.filter("p", lambda x: x["hit"])).cast("long").alias("hits"), md5(F.array_join(F.transform("p", lambda x: x["part"]), "|")).alias("joined"))


@query("SELECT doc_id, 'system' AS role1, 'Answer in ' || lang || '.' AS content1, 'user' AS role2, md5('Text: ' || text) AS content2 FROM documents")
def prompt_messages(spark, sf):
    m = docs(spark, sf).select("doc_id", text.render_messages("Answer in $lang.\n---\nText: $body", lang=F.col("lang"), body=F.col("text")).alias("m"))
    return m.select("doc_id", F.col("m")[0]["role"].alias("role1"), F.col("m")[0]["content"].alias("content1"), F.col("m")[1]["role"].alias("role2"), md5(F.col("m")[1]["content"]).alias("content2"))


@query("SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS INTEGER) AS tokens FROM documents")
def token_counts(spark, sf):
    return docs(spark, sf).select("doc_id", chunking.count_tokens(F.col("text")).alias("tokens"))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gis'), '<head\b.*?</head\s*>', '', 'gis') AS x FROM pages),
 b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(x, '<(nav)\b.*?</nav\s*>', '', 'gis'), '<footer\b.*?</footer\s*>', '', 'gis'), '<h([1-6])[^>]*>', chr(10) || '# ', 'gis') AS x FROM a),
 c AS (SELECT page_id, regexp_replace(regexp_replace(x, '</?(p|div|li|ul|ol|tr|table|section|article|h[1-6]|br)\b[^>]*>', chr(10), 'gis'), '<[^>]+>', '', 'gs') AS x FROM b),
 e AS (SELECT page_id, replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS x FROM c)
SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS plain FROM e""")
def html_plain_text(spark, sf):
    return load(spark, sf, "pages").select("page_id", md5(files.html_to_text(F.col("html"))).alias("plain"))


# --- chunks ---------------------------------------------------------------

MARKED = "array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i % 5 = 1 THEN '## H' || i || chr(10) || x ELSE x END), chr(10))"


def marked(spark, sf):
    """Documents with a heading before every fifth line."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 5 == 0, F.concat(F.lit("## H"), (i + 1).cast("string"), F.lit("\n"), x)).otherwise(x))
    return docs(spark, sf).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("path"), F.array_join(lines, "\n").alias("text"))


@query(rf"""WITH RECURSIVE ln AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, unnest(string_split({MARKED}, chr(10))) AS x, generate_subscripts(string_split({MARKED}, chr(10)), 1) AS i FROM documents),
 t AS (SELECT doc_id, i, trim(x) AS x, regexp_matches(trim(x), '^#{{1,6}}\s') AS head FROM ln WHERE trim(x) <> ''),
 h AS (SELECT *, count(*) FILTER (head) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM t),
 s AS (SELECT doc_id, section, max(regexp_replace(x, '^#{{1,6}}\s+', '')) FILTER (head) AS heading FROM h GROUP BY ALL),
 w AS (SELECT h.doc_id, h.section, s.heading, i, string_split_regex(x, '\s+') AS ws FROM h JOIN s USING (doc_id, section) WHERE NOT head),
 p AS (SELECT doc_id, section, heading, i, k, CASE WHEN len(ws) <= 40 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[k * 40 + 1 : k * 40 + 40], ' ') END AS x, len(ws[k * 40 + 1 : k * 40 + 40]) AS n
   FROM (SELECT *, unnest(range((len(ws) + 39) // 40)) AS k FROM w)),
 o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY i, k) AS r FROM p),
 f AS (SELECT doc_id, section, r, n AS used, 1 AS piece FROM o WHERE r = 1
   UNION ALL SELECT o.doc_id, o.section, o.r, CASE WHEN f.used + o.n <= 40 THEN f.used + o.n ELSE o.n END, CASE WHEN f.used + o.n <= 40 THEN f.piece ELSE f.piece + 1 END
   FROM f JOIN o ON o.doc_id = f.doc_id AND o.section = f.section AND o.r = f.r + 1),
 g AS (SELECT o.doc_id, o.section, piece, any_value(heading) AS heading, sum(n) AS n, md5(string_agg(x, chr(10) ORDER BY i, k)) AS body FROM o JOIN f USING (doc_id, section, r) GROUP BY ALL)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section, piece) - 1 AS INTEGER) AS idx, heading, CAST(n AS BIGINT) AS n, body FROM g""")  # fmt: skip
def chunk_documents(spark, sf):
    """Heading-aware chunks of at most 40 words; longer lines are cut."""
    c = chunking.chunk_documents(marked(spark, sf), 40)
    plain = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.array_join(F.filter(F.split(x, r"\s+"), lambda w: w != ""), " ")), "\n")
    return c.select("doc_id", "idx", F.array_join("headings", " > ").alias("heading"), chunking.count_tokens(F.col("text")).cast("long").alias("n"), md5(plain).alias("body"))


# --- wiki texts -----------------------------------------------------------

_BODY = """'# T' || doc_id || chr(10) || chr(10) || text || ' [^a' || (doc_id % 7) || '] and [^b] then [^a' || (doc_id % 7) || '] see [[Name ' || (doc_id % 5) || '|label]] or [[Other]].'
  || chr(10) || chr(10) || '## Details' || chr(10) || 'More [^c1] here.' || chr(10) || chr(10) || '[^b]: y' || chr(10) || chr(10) || CASE doc_id % 4 WHEN 0 THEN '## Sources' WHEN 1 THEN '##  related ' WHEN 2 THEN '## SOURCES' ELSE '## Related work' END || chr(10) || chr(10) || '[^b]: x' || chr(10)"""


def bodies(spark, sf):
    """Documents as drafts of pages, with citations, links and a source list."""
    n = lambda k: (F.col("doc_id") % k).cast("string")
    end = F.lit("] see [[Name ")
    heading = F.element_at(F.array(*(F.lit(x) for x in ("## Sources", "##  related ", "## SOURCES", "## Related work"))), (F.col("doc_id") % 4 + 1).cast("int"))
    body = F.concat(
        F.lit("# T"), F.col("doc_id").cast("string"), F.lit("\n\n"), "text", F.lit(" [^a"), n(7), F.lit("] and [^b] then [^a"), n(7), end, n(5),
        F.lit("|label]] or [[Other]].\n\n## Details\nMore [^c1] here.\n\n[^b]: y\n\n"), heading, F.lit("\n\n[^b]: x\n"),
    )
    return docs(spark, sf).select("doc_id", body.alias("body"))


@query(rf"""WITH x AS (SELECT doc_id, regexp_extract_all({_BODY}, '\[\^([^\]\s]+)\]', 1) AS l FROM documents)
SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS ids FROM x""")  # fmt: skip
def wiki_cited_ids(spark, sf):
    return bodies(spark, sf).select("doc_id", F.array_join(text.cited_ids(F.col("body")), " ").alias("ids"))


@query(rf"""WITH x AS (SELECT doc_id, {_BODY} AS b FROM documents),
 y AS (SELECT doc_id, regexp_replace(b, CASE WHEN doc_id % 2 = 0 THEN '[ \t]?\[\^b\]' ELSE '[ \t]?\[\^(?:b|a[0-9])\]' END, '', 'g') AS b FROM x)
SELECT doc_id, md5(b) AS body, CASE WHEN doc_id % 2 = 0 THEN 'a' || (doc_id % 7) || ' c1' ELSE 'c1' END AS kept FROM y""")  # fmt: skip
def wiki_validate(spark, sf):
    """Citations that aren't allowed go; the kept ids in first-seen order."""
    ok = F.when(F.col("doc_id") % 2 == 0, F.array(F.concat(F.lit("a"), (F.col("doc_id") % 7).cast("string")), F.lit("c1"), F.lit("z"))).otherwise(F.array(F.lit("c1")))
    v = bodies(spark, sf).select("doc_id", text.validate_citations(F.col("body"), ok).alias("v"))
    return v.select("doc_id", md5(F.col("v.text")).alias("body"), F.array_join("v.kept", " ").alias("kept"))


@query(rf"""WITH x AS (SELECT doc_id, {_BODY} AS b FROM documents)
SELECT doc_id, md5(replace(replace(b, '[[Other]]', 'Other'), '[[Name ' || (doc_id % 5) || '|label]]', CASE WHEN doc_id % 5 < 3 THEN '[[s' || (doc_id % 5) || '|label]]' ELSE 'label' END)) AS body,
  CASE WHEN doc_id % 5 < 3 THEN 'p' || (doc_id % 5) ELSE '' END AS linked FROM x""")  # fmt: skip
def wiki_links(spark, sf):
    """Links by name become links by slug where a page has the name."""
    known = F.create_map(*[x for k in range(3) for x in (F.lit(f"name {k}"), F.lit(f"s{k} p{k}"))])
    v = bodies(spark, sf).select("doc_id", text.resolve_links(F.col("body"), known).alias("v"))
    return v.select("doc_id", md5(F.col("v.text")).alias("body"), F.array_join("v.linked", " ").alias("linked"))


@query(rf"""WITH x AS (SELECT doc_id, regexp_replace({_BODY}, '^\s*# [^\n]*\n?', '') AS b FROM documents),
 y AS (SELECT doc_id, regexp_replace(regexp_replace(b, '(?ims)^##[ \t]+(?:Related|Sources)[ \t]*$.*\z', '', 'g'), '(?m)^\[\^[^\]]+\]:.*$', '', 'g') AS b FROM x)
SELECT doc_id, md5(regexp_replace(regexp_replace(b, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS body FROM y""")  # fmt: skip
def wiki_reserved_sections(spark, sf):
    return bodies(spark, sf).select("doc_id", md5(text.strip_reserved_sections(F.col("body"))).alias("body"))


@query(rf"""WITH x AS (SELECT doc_id, string_split_regex(regexp_replace({_BODY}, '^\s*# [^\n]*\n', ''), '(?m)^## ') AS p FROM documents),
 y AS (SELECT doc_id, unnest(p) AS part, generate_subscripts(p, 1) AS i FROM x),
 z AS (SELECT doc_id, i, CASE WHEN i = 1 THEN 'Summary' ELSE trim(regexp_extract(part, '^([^\n]*)', 1)) END AS section, CASE WHEN i = 1 THEN part ELSE regexp_replace(part, '^[^\n]*\n?', '') END AS t FROM y),
 w AS (SELECT doc_id, i, section, regexp_extract_all(t, '\[\^([^\]\s]+)\]', 1) AS l,
   regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\[\^[^\]]+\]', '', 'g'), '\[\[(?:[^\]|]*\|)?([^\]]*)\]\]', '\1', 'g'), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS t FROM z)
SELECT 'doc:' || doc_id || '#' || (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1) AS key, section, md5('T' || doc_id || chr(10) || t) AS body,
  array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS chunk_ids FROM w WHERE section <> 'Sources' AND t <> ''""")  # fmt: skip
def wiki_sections(spark, sf):
    s = F.col("doc_id").cast("string")
    pages = bodies(spark, sf).select(F.concat(F.lit("doc:"), s).alias("page_id"), F.concat(F.lit("T"), s).alias("title"), "body")
    return wiki.split_sections(pages).select("key", "section", md5(F.col("text")).alias("body"), F.array_join("chunk_ids", " ").alias("chunk_ids"))


@query("""WITH x AS (SELECT p_partkey, '---' || chr(10) || 'title: ' || to_json(p_name) || chr(10) || 'type: "Part"' || chr(10) || 'aliases: ' || CAST(to_json([p_brand]) AS VARCHAR) || chr(10) || 'version: ' || p_size || chr(10) || 'updated: 2024-01-02' || chr(10) || '---' || chr(10) AS f,
   '# ' || p_name || chr(10) || chr(10) || p_type || CASE WHEN p_size > 25 THEN chr(10) || chr(10) || '## Related' || chr(10) || chr(10) || '- one' || chr(10) || '- two' ELSE '' END || chr(10) || chr(10) || '## Sources' || chr(10) || chr(10) || '[^c]: c' || chr(10) AS b FROM part)
SELECT p_partkey, sha1(f || chr(10) || b) AS content_hash, md5(f[5:-6]) AS front, md5(b) AS body FROM x""")
def wiki_rendered(spark, sf):
    """Pages rendered and read back."""
    p = load(spark, sf, "part")
    lines = F.when(F.col("p_size") > 25, F.array(F.lit("- one"), F.lit("- two"))).otherwise(F.array().cast("array<string>"))
    rows = p.select("p_partkey", F.col("p_name").alias("name"), F.lit("Part").alias("type"), F.array("p_brand").alias("aliases"), F.col("p_type").alias("body"), lines.alias("lines"), F.array(F.lit("[^c]: c")).alias("sources"), F.col("p_size").alias("version"), F.to_timestamp(F.lit("2024-01-02 03:04:05")).alias("updated"))
    out = wiki.render_page(rows)
    front, body = wiki.parse_page(F.col("content"))
    return out.select("p_partkey", "content_hash", md5(front).alias("front"), md5(body).alias("body"))


_HEX = "left(sha1('part:' || p_partkey), 16)"


def parts(spark, sf):
    p = load(spark, sf, "part")
    key = F.left(F.sha1(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).cast("binary")), F.lit(16))
    return p.select(key.alias("entity_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("type"), F.col("p_partkey").alias("ord"), "p_size")


@query(rf"""WITH p AS (SELECT {_HEX} AS entity_id, replace({_NORM.format('p_name')}, ' ', '-') AS b, replace({_NORM.format('p_name')}, ' ', '-') || '-' || replace(replace({_NORM.format('p_brand')}, '#', 'sharp'), ' ', '-') AS ty, p_partkey AS ord FROM part),
 tk AS (SELECT entity_id, b || '-old' AS slug FROM p WHERE ord % 50 = 0 UNION ALL SELECT 'x', min(b) FROM p),
 nw AS (SELECT p.* FROM p WHERE entity_id NOT IN (SELECT entity_id FROM tk)),
 a AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY ord, entity_id) = 1 AND b NOT IN (SELECT slug FROM tk) AS tb FROM nw),
 c AS (SELECT *, NOT tb AND row_number() OVER (PARTITION BY ty, tb ORDER BY ord, entity_id) = 1 AND ty NOT IN (SELECT slug FROM tk) AND ty NOT IN (SELECT b FROM a WHERE tb) AS tt FROM a),
 s AS (SELECT entity_id, CASE WHEN tb THEN b WHEN tt THEN ty ELSE b || '-' || left(entity_id, 6) END AS slug, tb OR tt AS sure, ord, b FROM c),
 u AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY NOT sure, ord, entity_id) AS k FROM s)
SELECT entity_id, CASE WHEN NOT sure AND (k > 1 OR slug IN (SELECT slug FROM tk)) THEN b || '-' || entity_id ELSE slug END AS slug FROM u UNION ALL SELECT entity_id, slug FROM tk WHERE entity_id <> 'x'""")  # fmt: skip
def wiki_slugs(spark, sf):
    """File names of new pages beside those that are taken; every name once."""
    p = parts(spark, sf)
    b = text.slugify(F.col("name"))
    taken = p.where("ord % 50 = 0").select("entity_id", F.concat(b, F.lit("-old")).alias("slug")).unionByName(p.agg(F.min(b).alias("slug")).select(F.lit("x").alias("entity_id"), "slug"))
    return wiki.assign_slugs(p.select("entity_id", "name", "type", "ord"), taken)


@query(rf"""WITH p AS (SELECT {_HEX} AS entity_id, 's' || p_partkey AS slug, p_name, p_brand, p_partkey AS ord, CASE WHEN p_size <= 25 THEN 0 ELSE 1 END AS src FROM part),
 x AS (SELECT entity_id, slug, src, CASE WHEN src = 0 THEN 0 ELSE ord END AS ord, 0 AS pos, {_NORM.format('p_name')} AS norm FROM p UNION ALL SELECT entity_id, slug, src, CASE WHEN src = 0 THEN 0 ELSE ord END, 1, {_NORM.format('p_brand')} FROM p)
SELECT norm, entity_id AS page_id, slug FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY src, ord, pos, entity_id) AS k FROM x WHERE norm <> '') WHERE k = 1""")  # fmt: skip
def wiki_page_lookup(spark, sf):
    p = parts(spark, sf).withColumn("slug", F.concat(F.lit("s"), F.col("ord").cast("string"))).withColumn("aliases", F.array("type"))
    return wiki.page_lookup(p.where("p_size <= 25"), p.where("p_size > 25"))


@query("SELECT p_brand AS entity_type, md5(string_agg('- [[s' || p_partkey || '|' || p_name || ']]', chr(10) ORDER BY lower(p_name), p_name, 's' || p_partkey)) AS listing FROM part GROUP BY 1")
def wiki_index_listing(spark, sf):
    p = load(spark, sf, "part").select(F.col("p_brand").alias("entity_type"), F.col("p_name").alias("title"), F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("slug"))
    return wiki.render_index(p).select("entity_type", md5(F.col("listing")).alias("listing"))


@query(f"""WITH {d.ENTITIES}, {d.RELATIONS}, {d.UNDIRECTED}, t AS (SELECT u.*, row_number() OVER (PARTITION BY entity_id ORDER BY weight DESC, predicate, other_id, direction) AS k FROM u),
 l AS (SELECT t.entity_id, k, direction, replace(predicate, '_', ' ') AS p, CASE WHEN n.type = 'Part' THEN '[[s-' || other_id || '|' || n.name || ']]' ELSE n.name END AS o FROM t JOIN n ON n.entity_id = other_id WHERE k <= 30)
SELECT entity_id, count(*) AS n, md5(string_agg(CASE direction WHEN 'out' THEN '- ' || p || ' ' || o ELSE '- ' || o || ' ' || p END, chr(10) ORDER BY k)) AS lines FROM l GROUP BY 1""")  # fmt: skip
def wiki_related_lines(spark, sf):
    e = d.named_entities(spark, sf)
    slugs = e.where("type = 'Part'").select("entity_id", F.concat(F.lit("s-"), "entity_id").alias("slug"))
    out = wiki.related(d.relations(spark, sf), e, slugs)
    return out.select("entity_id", F.size("lines").cast("long").alias("n"), md5(F.array_join("lines", "\n")).alias("lines"))


@query(f"""WITH {d.CHUNKS}, {d.MENTIONS}, nr AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY chunk_id DESC) AS rank FROM m), f AS (SELECT entity_id, chunk_id, 0.5 AS score, rank AS pos FROM nr WHERE rank <= 12),
 ct AS (SELECT entity_id, min(chunk_id) AS chunk_id FROM m GROUP BY 1 UNION SELECT entity_id, max(chunk_id) FROM m GROUP BY 1),
 o AS (SELECT entity_id, chunk_id, row_number() OVER (PARTITION BY entity_id ORDER BY chunk_id) AS k FROM ct ANTI JOIN f USING (entity_id, chunk_id))
SELECT entity_id, chunk_id, CAST(score AS DOUBLE) AS score, pos FROM f UNION ALL SELECT entity_id, chunk_id, 0.0, k + 12 FROM o WHERE k <= 12""")  # fmt: skip
def wiki_evidence(spark, sf):
    """Nearest chunks (here: the last ones), then still valid old citations."""
    from pyspark.sql.window import Window

    m = cut(d.mentions(spark, sf))
    near = m.withColumn("rank", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("chunk_id")))).withColumn("score", F.lit(0.5))
    ends = m.groupBy("entity_id").agg(F.array_distinct(F.array(F.min("chunk_id"), F.max("chunk_id"), F.lit("gone"))).alias("c"))
    cites = ends.select(F.col("entity_id").alias("page_id"), F.explode("c").alias("chunk_id"))
    return wiki.evidence(near, cites, m).withColumn("pos", F.col("pos").cast("long"))
