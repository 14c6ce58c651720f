"""Quality rules as a ledger of failure bits, and policies over it.

Every rule is evaluated once for each document.  The ledger keeps what was measured and
one bit a rule (``RULES``: set where the document fails it), so it need not be computed
again when a policy changes: a policy is a named, versioned mask of bits
(``POLICIES``), and a document passes where its bits and the mask have none in common.
Ablations come from the bits alone: documents are counted for each combination of
failed rules of the policy (at most two to the number of rules), and what each rule
removes, what it alone removes, what the policy keeps without it, and which other rules
fail whenever, or ever, it fails are sums, ``bit_and`` and ``bit_or`` of those.

Words are the contracts' words.  Rules compare whole numbers, so they are exact.

Defined results
* null text: as the empty one; no words, so ``few_words`` fails and the ratios don't.
* repeated rows: each is judged on its own.  Null ids are kept.  Empty table: no rows.
* very long texts are measured whole; lines are cut at ``\\n`` only.
* other columns take no part in the digest; ``ledger`` keeps those that are asked for,
  and refuses one whose name is a measurement's, ``failed`` or ``_text``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialize

MEASURES = ("n_words", "word_chars", "longest_word", "n_symbols", "n_lines", "n_dup_lines", "n_ellipsis_lines", "n_bullet_lines", "n_repeat_words", "n_alpha_words", "n_upper_words", "top_word")
WINDOW = 3

# fixed values: words, symbols, and marks at the end or beginning of a line
_WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
SYMBOLS = "#*$%&|<>"
ELLIPSES = ("...", "…")
BULLETS = ("•", "●", "-", "*", "‣")

_LETTERS = re.compile(r"[^\W\d_]").search


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words that lie in a window of words found twice or more, the first included."""
    runs = list(zip(*(words[k:] for k in range(window)), strict=False))
    counts = Counter(runs)
    if len(counts) == len(runs):
        return 0
    covered = end = 0
    for at, run in enumerate(runs):
        if counts[run] > 1:
            covered += at + window - max(at, end)
            end = at + window
    return covered


def measure(text: str | None) -> tuple[int, ...]:
    """The ``MEASURES`` of one whole text."""
    text = text or ""
    words = _WORDS(text)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if _WORDS(x)]
    stripped = [x.strip() for x in lines]
    alpha = upper = 0
    for word, n in counts.items():
        if _LETTERS(word):
            alpha += n
            if word.isupper() and len(word) > 1:
                upper += n
    return (
        len(words),
        sum(map(len, words)),
        max(map(len, counts), default=0),
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        sum(x.endswith(ELLIPSES) for x in stripped),
        sum(x.startswith(BULLETS) for x in stripped),
        repeated_words(words),
        alpha,
        upper,
        max(counts.values(), default=0),
    )


@dataclass(frozen=True)
class Rule:
    """``fails`` is an expression over measurements that Spark and DuckDB both take."""

    name: str
    fails: str


#: A rule's bit is its place; add new rules at the end, and never take one out.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("short_words", "word_chars < 3 * n_words"),
    Rule("long_words", "word_chars > 10 * n_words"),
    Rule("letters", "10 * n_alpha_words < 8 * n_words"),
    Rule("capitals", "10 * n_upper_words > 3 * n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("one_word", "n_words >= 10 AND 10 * top_word > 3 * n_words"),
    Rule("endless_word", "longest_word > 1000"),
    Rule("ellipses", "10 * n_ellipsis_lines > 3 * n_lines"),
    Rule("bullets", "10 * n_bullet_lines > 9 * n_lines"),
)
BIT = {r.name: 1 << k for k, r in enumerate(RULES)}


def mask_of(*names: str) -> int:
    return sum(BIT[n] for n in set(names))


BASE = mask_of("few_words", "repeated_windows")
#: Versions are never changed, only added.
POLICIES = {
    "base-1": BASE,
    "web-1": BASE | mask_of("symbols", "short_words", "long_words", "letters"),
    "web-2": BASE | mask_of("symbols", "short_words", "long_words", "letters", "capitals", "repeated_lines", "one_word", "endless_word", "ellipses", "bullets"),
}
POLICY = "web-2"


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``keep``, the measurements, and ``failed``, the bits of the rules that fail."""
    if clash := set(keep) & {*MEASURES, "failed", "_text"}:
        raise ValueError(f"columns with names of the ledger: {sorted(clash)}")
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text).alias("_text"))

    def run(batches):
        for b in batches:
            found = [measure(t) for t in b.column(len(keep)).to_pylist()]
            columns = zip(*found, strict=True) if found else [[]] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), *(pa.array(c, type=pa.int64()) for c in columns)], names=[*keep, *MEASURES])
        give_back()

    fields = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), *(f"{m} long" for m in MEASURES)]
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(rules):
        bits = bits + F.when(F.expr(rule.fails), F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
    return rows.mapInArrow(run, ", ".join(fields)).withColumn("failed", bits)


def judged(rows: DataFrame, policy: str | int = POLICY, name: str = "kept") -> DataFrame:
    """Adds ``name``: no rule of the policy fails."""
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    return rows.withColumn(name, F.col("failed").bitwiseAND(mask) == 0)


def ablations(rows: DataFrame, policy: str | int = POLICY, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row for each rule of the policy, from the ledger's bits alone.

    rule, removes (documents that fail it), removes_alone (and no other rule of the
    policy), kept (by the whole policy), kept_without (by the policy without it),
    always_with and ever_with (bits of the policy's other rules that fail in all, or
    in any, of the documents that it removes; null where it removes none).
    """
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    combined = rows.groupBy(F.col("failed").bitwiseAND(mask).alias("failed")).agg(F.count(F.lit(1)).alias("n"))
    listed = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, r in enumerate(rules) if mask >> k & 1))
    each = combined.withColumn("_r", F.explode(listed)).select("failed", "n", "_r.*")
    hit, others = F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("failed").bitwiseAND(F.bitwise_not("bit"))
    total: Callable = lambda where: F.coalesce(F.sum(F.when(where, F.col("n"))), F.lit(0))
    return each.groupBy("rule", "bit").agg(
        total(hit).alias("removes"),
        total(F.col("failed") == F.col("bit")).alias("removes_alone"),
        total(F.col("failed") == 0).alias("kept"),
        total(others == 0).alias("kept_without"),
        F.bit_and(F.when(hit, others)).alias("always_with"),
        F.bit_or(F.when(hit, others)).alias("ever_with"),
    )


DIGEST = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def judge_documents(docs: DataFrame, policy: str = POLICY) -> DataFrame:
    """Digest form: the ledger, stored, under a policy; ``failed`` holds all rules' bits."""
    stored = materialize(ledger(docs), "ledger")
    out = judged(stored, policy).withColumn("base_failed", F.col("failed").bitwiseAND(BASE) != 0)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), *DIGEST[1:], "failed")


_W = "regexp_extract_all({0}, '[^\\x20\\x09-\\x0D]+')"
_LINES = "list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))"
_UPPER = "length(x) > 1 AND regexp_matches(x, '\\p{Lu}') AND NOT regexp_matches(x, '[\\p{Ll}\\p{Lt}\\x{AA}\\x{BA}]')"
_TRIMMED = "list_transform(l, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g'))"
_BITS = " + ".join(f"CASE WHEN {r.fails} THEN {1 << k} ELSE 0 END" for k, r in enumerate(RULES))
SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
 s AS (SELECT *, {_W.format("t")} AS w, {_LINES} AS l FROM d),
 e AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM s),
 g AS (SELECT r, i, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM e WINDOW o AS (PARTITION BY r ORDER BY i)),
 b AS (SELECT r, i FROM g WHERE z IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, x, y, z) > 1),
 c AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + k AS i FROM b, (SELECT unnest([0, 1, 2]) AS k)) GROUP BY r),
 q AS (SELECT r, max(n) AS top FROM (SELECT r, x, count(*) AS n FROM e GROUP BY r, x) GROUP BY r),
 m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    coalesce(list_max(list_transform(w, lambda x: length(x))), 0) AS longest_word, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    len(l) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    len(list_filter({_TRIMMED}, lambda x: ends_with(x, '...') OR ends_with(x, '…'))) AS n_ellipsis_lines,
    len(list_filter({_TRIMMED}, lambda x: regexp_matches(x, '^[•●*‣-]'))) AS n_bullet_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) AS n_alpha_words,
    len(list_filter(w, lambda x: {_UPPER})) AS n_upper_words, coalesce(top, 0) AS top_word
    FROM s LEFT JOIN c USING (r) LEFT JOIN q USING (r)),
 f AS (SELECT *, CAST({_BITS} AS BIGINT) AS failed FROM m)
SELECT {", ".join(DIGEST[:6])}, failed & {BASE} <> 0 AS base_failed, failed & {POLICIES[POLICY]} = 0 AS kept, failed FROM f
"""
