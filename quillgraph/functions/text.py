"""Identity, text, number and JSON functions as Spark column expressions.

Built-in functions wherever they can say it; Arrow-batched pandas UDFs only for
what Spark has no function for (NFKC, case folding, byte-capped slugs, link
rewriting).
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# fixed values: identity of names and ids
NAMESPACE_HEX = "5b0c9a8e3f614d2a9b7e0c1d2e3f4a5b"
SLUG_CHARS, SLUG_BYTES, SLUG_HASH = 80, 200, 8
ID_HEX = 16
SNIPPET, ERROR_LIMIT = 200, 500
NEEDS_TRANSLATION = 0.3


# --- identity -------------------------------------------------------------


def file_doc_id(content: Column) -> Column:
    """First 16 hex digits of the SHA-256 of a file's bytes or a text."""
    return F.left(F.sha2(content.cast("binary"), 256), F.lit(ID_HEX))


def chunk_id(doc_id: Column, idx: Column) -> Column:
    return F.concat(doc_id, F.lit(":"), F.lpad(idx.cast("string"), 5, "0"))


def split_chunk_id(key: Column) -> tuple[Column, Column]:
    """(document, index), split at the last colon."""
    idx = F.substring_index(key, ":", -1)
    return F.expr(f"left({_sql(key)}, length({_sql(key)}) - length(substring_index({_sql(key)}, ':', -1)) - 1)"), idx.cast("int")


def _sql(c: Column) -> str:
    name = c._jc.toString()
    return f"`{name}`" if re.fullmatch(r"\w+", name) else name


_WORDS = re.compile(r"(?:(?!_)\w|[+#])+")  # what a name keeps; all else separates


def _normal(name: str | None) -> str:
    return " ".join(_WORDS.findall(unicodedata.normalize("NFKC", name or "").casefold()))


@pandas_udf(StringType())
def normalize_name(names: pd.Series) -> pd.Series:
    """NFKC, case folding, anything but word characters, + and # to one space."""
    return names.map(_normal, na_action="ignore")


def name_key(normal: Column) -> Column:
    return F.replace(normal, F.lit(" "), F.lit(""))


@pandas_udf(ArrayType(StringType()))
def entity_name_keys(names: pd.Series) -> pd.Series:
    """Sorted distinct non-empty keys of an array of names."""
    return names.map(lambda a: sorted({_normal(n).replace(" ", "") for n in a if n is not None} - {""}), na_action="ignore")


def entity_id(kind: Column, normal: Column) -> Column:
    return F.left(F.sha1(F.concat(F.lower(kind), F.lit("|"), normal).cast("binary")), F.lit(ID_HEX))


def _slug(name: str | None) -> str:
    whole = _normal(name).translate({35: "sharp", 32: "-"})
    raw = whole.encode()
    if not whole:
        return "untitled"
    if len(whole) > SLUG_CHARS or len(raw) > SLUG_BYTES:
        room = SLUG_HASH + 1
        cut = whole[: SLUG_CHARS - room].encode()[: SLUG_BYTES - room].decode(errors="ignore")
        return f"{cut.rstrip('-')}-{hashlib.sha1(raw).hexdigest()[:SLUG_HASH]}"
    return whole


@pandas_udf(StringType())
def slugify(names: pd.Series) -> pd.Series:
    return names.map(_slug)


def point_id(key: Column, namespace_hex: str = NAMESPACE_HEX) -> Column:
    """UUID version 5 of ``key`` in the namespace."""
    h = F.left(F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), key.cast("binary"))), F.lit(32))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.lower(F.hex(F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, allow_nan=False, separators=(",", ":"))


def fingerprint(value) -> str:
    """SHA-256 of the canonical JSON of a driver-side value."""
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def row_fingerprint(*columns: Column) -> Column:
    """SHA-256 of the JSON of columns, in the order given."""
    return F.sha2(F.to_json(F.struct(*columns)).cast("binary"), 256)


def lock_key(target: Column, key: Column) -> Column:
    """Signed 64-bit number from a SHA-256 prefix."""
    return F.conv(F.left(F.sha2(F.concat_ws("\u0000", target, key).cast("binary"), 256), F.lit(16)), 16, -10).cast("long")


# --- text -----------------------------------------------------------------


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def format_document(text: Column, title: Column, template: str) -> Column:
    out = F.replace(F.lit(template), F.lit("{title}"), F.coalesce(title, F.lit("none")))
    return F.replace(out, F.lit("{content}"), text)


def format_query(query: Column, template: str) -> Column:
    return F.replace(F.lit(template), F.lit("{content}"), query)


def needs_translation(question: Column) -> Column:
    """Over 0.3 of the letters lie outside ASCII; without letters: false."""
    letters = F.length(F.regexp_replace(question, r"[^\p{L}]", ""))
    other = F.length(F.regexp_replace(question, r"[^\p{L}]|[A-Za-z]", ""))
    return (letters > 0) & (other > F.lit(NEEDS_TRANSLATION) * letters)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def block_label(kind: Column, path: Column, page: Column, title: Column) -> Column:
    chunk = F.concat(F.lit("document "), basename(path), F.when(page.isNotNull(), F.concat(F.lit(", p."), page.cast("string"))).otherwise(""))
    return F.when(kind == "chunk", chunk).when(kind == "wiki", F.concat(F.lit("wiki "), title)).otherwise(F.concat(kind, F.lit(" "), title))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def strip_think(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""))


def clean_json(text: Column) -> Column:
    """From the first { to the last } of a model's reply, fences removed."""
    x = F.regexp_replace(strip_think(text), r"(?is)^\s*```(?:json)?\s*|\s*```\s*$", "")
    return F.coalesce(F.nullif(F.regexp_extract(x, r"(?s)(\{.*\})", 1), F.lit("")), x)


# fixed values: names whose values are secrets, and marks of other secrets
SECRET_NAMES = ("api_key", "api-key", "apikey", "access_token", "access-token", "accesstoken", "token", "password", "passwd", "secret", "key")
MASK = "***"
BEARER, KEY_START = "Bearer", "sk-"


def safe_error(kind: Column, message: Column, limit: int = ERROR_LIMIT) -> Column:
    """kind: message, with secrets masked: bearer tokens, keys, user and password of an
    address, and the values of secret names, as assignments or as JSON pairs."""
    value = "[^\\s\"'&,;}]+"
    quoted_or_bare = f"(?i)\\b({'|'.join(SECRET_NAMES)})(\"?\\s*[=:]\\s*\"?){value}"
    masks = [
        (f"(?i)\\b{BEARER}\\s+[^\\s\"',;]+", f"{BEARER} {MASK}"),
        (f"\\b{KEY_START}[\\w-]+", KEY_START + MASK),
        ("://[^\\s/:@]+:[^\\s/@]+@", f"://{MASK}@"),
        (quoted_or_bare, f"$1$2{MASK}"),
    ]
    x = F.concat_ws(": ", kind, message)
    for pattern, put in masks:
        x = F.regexp_replace(x, pattern, put)
    return F.when(F.length(x) > limit, F.concat(F.left(x, F.lit(limit - 1)), F.lit("…"))).otherwise(x)


def cited_ids(body: Column) -> Column:
    """Distinct [^id] in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(body, F.lit(r"\[\^([^\]\s]+)\]"), 1))


def cited_numbers(answer: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), 1), lambda x: x.cast("int")))


def strip_reserved_sections(body: Column) -> Column:
    """The lines before the first heading Related or Sources (level two, any case),
    without a leading title and with footnote definitions blanked; runs of empty lines
    become one."""
    lines = F.split(strip(body), "\n")
    reserved = F.transform(lines, lambda x: x.rlike(r"(?i)^##[ \t]+(related|sources)[ \t]*$"))
    end = F.coalesce(F.nullif(F.array_position(reserved, F.lit(True)), F.lit(0)) - 1, F.size(lines).cast("long")).cast("int")
    begin = F.when(F.startswith(F.element_at(lines, 1), F.lit("# ")), 2).otherwise(1)
    kept = F.slice(lines, begin, F.greatest(F.lit(0), end - begin + 1))
    blanked = F.transform(kept, lambda x: F.when(x.rlike(r"^\[\^[^\]]+\]:"), F.lit("")).otherwise(x))
    return strip(F.regexp_replace(F.array_join(blanked, "\n"), r"\n{3,}", "\n\n"))


def validate_citations(body: Column, allowed: Column) -> Column:
    """struct of text and kept: citations that aren't allowed go, each with the blank
    before it; the kept ids in first-seen order.  Null bodies are empty, and null lists
    allow nothing."""
    body, allowed = F.coalesce(body, F.lit("")), F.coalesce(allowed, F.array().cast("array<string>"))
    mark = r"[ \t]?\[\^[^\]\s]+\]"
    between = F.split(body, mark, -1)
    marks = F.regexp_extract_all(body, F.lit(f"({mark})"), F.lit(1))
    ids = F.regexp_extract_all(body, F.lit(r"[ \t]?\[\^([^\]\s]+)\]"), F.lit(1))
    stays = F.zip_with(marks, ids, lambda m, i: F.when(F.array_contains(allowed, i), m).otherwise(F.lit("")))
    text = F.array_join(F.zip_with(between, stays, lambda t, m: F.concat(t, F.coalesce(m, F.lit("")))), "")
    return F.struct(text.alias("text"), F.array_distinct(F.filter(ids, lambda i: F.array_contains(allowed, i))).alias("kept"))


@pandas_udf(StructType([StructField("text", StringType()), StructField("linked", ArrayType(StringType()))]))
def resolve_links(bodies: pd.Series, names: pd.Series) -> pd.DataFrame:
    """[[Name|label]] to [[slug|label]] where ``names`` (normal name to
    "slug page_id") knows it, else to its label; page ids in first-seen order."""
    out = []
    for body, known in zip(bodies, names, strict=True):
        table, linked = dict(known) if known is not None else {}, []

        def put(m, table=table, linked=linked):
            label = m.group(2) or m.group(1)
            hit = table.get(_normal(m.group(1)))
            if not hit:
                return label
            slug, page = hit.split(" ", 1)
            if page not in linked:
                linked.append(page)
            return f"[[{slug}|{label}]]"

        out.append((re.sub(r"\[\[([^\]|]+)(?:\|([^\]]*))?\]\]", put, body or ""), linked))
    return pd.DataFrame(out, columns=["text", "linked"])


def wiki_link(name: Column, slug: Column) -> Column:
    return F.when(slug.isNotNull(), F.concat(F.lit("[["), slug, F.lit("|"), name, F.lit("]]"))).otherwise(name)


def predicate_label(p: Column) -> Column:
    return F.replace(p, F.lit("_"), F.lit(" "))


def snake_case(p: Column, default: str = "related_to") -> Column:
    x = F.trim(F.regexp_replace(F.lower(p), r"[^\p{L}\p{N}]+", " "))
    return F.coalesce(F.nullif(F.replace(x, F.lit(" "), F.lit("_")), F.lit("")), F.lit(default))


def split_matches(text: Column, needles: list[str]) -> Column:
    """Array of (part, is_match): the text cut at case-insensitive needles."""
    wanted = [n for n in needles if n]
    if not wanted:
        return F.array(F.struct(text.alias("part"), F.lit(False).alias("hit")))
    pattern = "(?i)" + "|".join(re.escape(n) for n in sorted(wanted, key=len, reverse=True))
    marked = F.regexp_replace(text, f"({pattern})".replace("((?i)", "(?i)("), "\u0001\u0002$1\u0001")
    parts = F.filter(F.split(marked, "\u0001"), lambda p: (p != "") & (p != "\u0002"))
    return F.transform(parts, lambda p: F.struct(F.replace(p, F.lit("\u0002"), F.lit("")).alias("part"), F.startswith(p, F.lit("\u0002")).alias("hit")))


def node_size(value: Column, low: Column, high: Column, least: float, most: float) -> Column:
    """Square-root scale into [least, most]; a degenerate range gives the middle."""
    part = F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - low) / F.nullif(high - low, F.lit(0.0)))))
    return F.coalesce(F.lit(least) + part * (most - least), F.lit((least + most) / 2))


def render(template: str, **values: Column) -> Column:
    """Strict $name substitution: every name of the template has a value."""
    names = set(re.findall(r"\$([a-z_]+)", template))
    if names != set(values):
        raise KeyError(f"template names {sorted(names)}, given {sorted(values)}")
    parts, at = [], 0
    for m in re.finditer(r"\$([a-z_]+)", template):
        parts += [F.lit(template[at : m.start()]), values[m.group(1)].cast("string")]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def render_messages(template: str, boundary: str = "\n---\n", **values: Column) -> Column:
    """array<struct<role,content>>: system above the boundary, user below."""
    system, _, user = template.partition(boundary)
    used = lambda t: {n: c for n, c in values.items() if f"${n}" in t}
    message = lambda role, t: F.struct(F.lit(role).alias("role"), render(t, **used(t)).alias("content"))
    return F.array(message("system", system), message("user", user))


# --- vectors --------------------------------------------------------------


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def truncate_normalize(v: Column, dim: int) -> Column:
    """The first ``dim`` values at unit length; too short or zero is an error."""
    cut = F.slice(v, 1, dim)
    n = norm(cut)
    bad = (F.size(v) < dim) | (n == 0) | F.isnan(n) | (n == float("inf"))
    return F.when(bad, F.raise_error(F.lit("vector is too short, zero or not finite")).cast("array<double>")).otherwise(F.transform(cut, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot / F.nullif(norm(a) * norm(b), F.lit(0.0))


def day_start(seconds: Column) -> Column:
    return F.date_trunc("DAY", F.timestamp_seconds(seconds))


def finite(x: Column) -> Column:
    """NaN and infinities to null, as scores leave the engine."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


# --- answers and caches ---------------------------------------------------


def source_item(number: Column, kind: Column, ref: Column, path: Column, upload: Column) -> Column:
    """What a reader sees of a source: no folders, the document's id, the name it
    was uploaded under."""
    doc_id = F.when(kind == "chunk", F.substring_index(ref, ":", 1))
    return F.struct(number.alias("number"), kind.alias("kind"), ref.alias("ref"), doc_id.alias("doc_id"), F.coalesce(upload, basename(path)).alias("label"))


def answer_meta(latency_ms: Column, tokens_in: Column, tokens_out: Column, context_tokens: Column, budget: int) -> Column:
    return F.struct(latency_ms.alias("latency_ms"), tokens_in.alias("tokens_in"), tokens_out.alias("tokens_out"), context_tokens.alias("context_tokens"), F.lit(budget).alias("context_budget"))


def types_signature(types: list[str]) -> str:
    """Hash of an ordered list of types."""
    return hashlib.sha256(canonical_json(types).encode()).hexdigest()[:12]


def cache_version(prompt: str, types: list[str]) -> str:
    return f"{prompt}:{types_signature(types)}"


def format_types(types: list[str]) -> str:
    return ", ".join(types)
