"""Document fingerprints as Merkle trees over paragraphs and sections.

Passages are sentences of one paragraph (line).  Where one is longer than 32
characters it ends after the next word that ends in one of six letters, else, in
text without spaces, at the next letter of a fixed set, so borders follow content
there, too; only 112 characters without any of these are cut by length.  Neighbouring passages join into one leaf until a passage whose hash ends
in ``level`` zero bits closes it, so borders follow content and an edit moves
none but its own.  ``level`` grows with the logarithm of the passage count, which
keeps a tree at some hundred leaves whatever the text's length.  Repeated passages
give no new borders, so a stretch of over ``RUN << level`` characters without a
border is cut at the borders of the next finer level inside it, and so on; this
depends on the stretch alone, and texts of few distinct passages can get more
leaves.  Because a border of a coarse level is a border of every finer one, trees
of different levels are compared by joining the finer tree's leaves.  Runs of
leaves form sections in the same way, three bits coarser, and sections the root.

A fingerprint is text::

    m4 : root (32 hex) : level : leaf leaf leaf ... : section section ...

with the leaves in base 64, nine bytes each: four of hash, four of length, one for
how coarse the closing border is; and the first four bytes of each section's digest.  A leaf's digest (128 bits) is of its text, a section's of its
leaves' digests in order, and the root's of the sections'.  Equal roots mean equal
texts.  A leaf's stored hash is a polynomial in its passages' hashes, which keeps
their order and lets neighbouring leaves join without the text.
Texts of up to 512 characters, where passages are too few to compare, add a list of
their words (four bytes of hash, two of length), by which two such texts are compared.
``changed_sections`` aligns the sections in order and descends into those that
differ only.

Likeness is twice the length of leaves in common (as a multiset) over both
lengths: 1 for equal texts, 0 for texts without a leaf in common.  The order of
passages in a leaf counts, that of leaves doesn't; roots and ``changed_sections``
tell moved leaves.

Defined results
* null and empty texts: the empty tree, like any other empty tree at 1.
* very long texts: worked whole, in one pass.
* repeated ids: ordered by a hash of their text, then the text; repeated rows
  follow one another.
* null ids come last in descending order.  A table of one row: its own next.
* empty table: no rows.  Other columns take no part.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter
from difflib import SequenceMatcher
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# ends of sentences, and borders of longer stretches
_END, _WORD_END, _LETTER = r".!?\n。！？", r"(?<=[dnty05])[\s,;]", r"08HPXhpxのい的是"
_CLOSE = rf"[{_END}]++\s*+"
PASSAGE = re.compile(rf"[^{_END}]{{0,32}}+(?:{_CLOSE}|[^{_END}]{{0,96}}?(?:{_WORD_END}|{_CLOSE})|[^{_END}{_LETTER}]{{0,80}}+(?:{_CLOSE}|[{_LETTER}]|(?<=[^{_END}])))")
LEAVES = 128
#: Texts of up to this many characters also list their words.
SHORT = 512
_WORDS = re.compile(r"\S+\s*|\s+").findall
RUN = 256
SECTION_BITS = 3
_PRIME, _BASE = (1 << 30) - 35, 718_281_828
_POWERS = [pow(_BASE, n, _PRIME) for n in range(256)]
_LEAF = np.dtype([("hash", ">u4"), ("length", ">u4"), ("zeros", "u1")])
_SHORT_WORD = np.dtype([("hash", ">u4"), ("length", ">u2")])


def _trailing_zeros(h: int) -> int:
    return min(63, (h & -h).bit_length() - 1) if h else 63


def _packed(rows: list[tuple], kind: np.dtype) -> str:
    return base64.b64encode(np.array(rows, dtype=kind).tobytes()).decode()


def _unpacked(s: str, kind: np.dtype) -> list[tuple]:
    return np.frombuffer(base64.b64decode(s), dtype=kind).tolist()


def passages(text: str) -> list[str]:
    return [p for p in PASSAGE.findall(text) if p]


def _groups(items: list[tuple[int, int, int]], level: int) -> list[list[tuple[int, int, int]]]:
    """(hash, length, zeros) items in runs that end at borders of ``level``, or of
    finer levels where a run is too long.

    Runs of a level are unions of runs of any finer level, so grouping the runs of
    a finer tree gives what grouping its passages gives.
    """
    out, run, chars, last = [], [], 0, len(items) - 1
    for k, x in enumerate(items):
        run.append(x)
        chars += x[1]
        if x[2] >= level or k == last:
            if level and chars > RUN << level and len(run) > 1:
                out += _groups(run, level - 1)
            else:
                out.append(run)
            run, chars = [], 0
    return out


def _join(items: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """One (hash, length, zeros) of neighbouring items."""
    h = chars = 0
    for part, n, _ in items:
        h = (h * (_POWERS[n] if n < 256 else pow(_BASE, n, _PRIME)) + part) % _PRIME
        chars += n
    return h, chars, items[-1][2]


def _digest(data: bytes, node: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16, person=node).digest()


def fingerprint(text: str | None) -> str:
    text = text or ""
    parts = passages(text)
    level = max(0, (len(parts) // LEAVES).bit_length())
    items = []
    for p in parts:
        h = xxhash.xxh3_64_intdigest(p.encode("utf-8", "surrogatepass"))
        items.append((h % _PRIME, len(p), _trailing_zeros(h)))
    leaves, at = [], 0
    digests = []
    for g in _groups(items, level):
        leaf = _join(g)
        leaves.append(leaf)
        digests.append(_digest(text[at : at + leaf[1]].encode("utf-8", "surrogatepass"), b"leaf"))
        at += leaf[1]
    if leaves:
        leaves[-1] = (*leaves[-1][:2], 63)
    sections, at = [], 0
    for g in _groups(leaves, level + SECTION_BITS):
        sections.append(_digest(b"".join(digests[at : at + len(g)]), b"section"))
        at += len(g)
    root = _digest(b"".join(sections), b"root").hex()
    out = f"m4:{root}:{level}:{_packed(leaves, _LEAF)}:{base64.b64encode(b''.join(d[:4] for d in sections)).decode()}"
    if len(text) <= SHORT:
        out += ":" + _packed([(xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) >> 32, len(w)) for w in _WORDS(text)], _SHORT_WORD)
    return out


def parse(fp: str) -> tuple[str, int, list[tuple[int, int, int]], list[bytes]]:
    """(root, level, leaves, sections); a section's leaves follow from their borders."""
    _, root, level, body, nodes = fp.split(":")[:5]
    raw = base64.b64decode(nodes)
    return root, int(level), _unpacked(body, _LEAF), [raw[i : i + 4] for i in range(0, len(raw), 4)]


def _coarser(leaves: list[tuple[int, int, int]], level: int) -> list[tuple[int, int, int]]:
    """The leaves joined up to borders of ``level``."""
    return [_join(g) for g in _groups(leaves, level)]


def likeness(a: str, b: str) -> float:
    root_a, level_a, leaves_a, _ = parse(a)
    root_b, level_b, leaves_b, _ = parse(b)
    if root_a == root_b:
        return 1.0
    level = max(level_a, level_b)
    x, y = Counter(), Counter()
    words_a, words_b = a.split(":")[5:], b.split(":")[5:]
    if words_a and words_b:
        for words, c in ((words_a[0], x), (words_b[0], y)):
            for h, n in _unpacked(words, _SHORT_WORD):
                c[h, n] += n
        leaves_a, leaves_b = [], []
    for leaves, low, c in ((leaves_a, level_a, x), (leaves_b, level_b, y)):
        for h, n, _ in _coarser(leaves, level) if level > low else leaves:
            c[h, n] += n
    both = sum(min(n, y[k]) for k, n in x.items() if k in y)
    total = sum(x.values()) + sum(y.values())
    return 2 * both / total if total else 1.0


def changed_sections(a: str, b: str) -> list[tuple[int, int]]:
    """Code-point ranges of ``a`` that have no equal at their place in ``b``.

    Sections are aligned in order, then the leaves of those that differ.  Where
    ``b`` only has more, the range is empty: (place, place).
    """
    root_a, level_a, leaves_a, nodes_a = parse(a)
    root_b, level_b, leaves_b, nodes_b = parse(b)
    if root_a == root_b:
        return []
    level = max(level_a, level_b)
    trees = []
    for leaves, low, nodes in ((leaves_a, level_a, nodes_a), (leaves_b, level_b, nodes_b)):
        groups = _groups(leaves if low == level else _coarser(leaves, level), level + SECTION_BITS)
        # sections of different levels have no common nodes and join from their leaves
        trees.append((groups, nodes if level_a == level_b else [_join(g)[:2] for g in groups]))
    (groups_a, keys_a), (groups_b, keys_b) = trees
    ends = [0, *accumulate(sum(n for _, n, _ in g) for g in groups_a)]
    out: list[tuple[int, int]] = []
    for i, j, k, m in _differing(keys_a, keys_b):
        own = [x for g in groups_a[i:j] for x in g]
        other = [x for g in groups_b[k:m] for x in g]
        places = [ends[i], *accumulate((n for _, n, _ in own), initial=ends[i])][1:]
        out += [(places[p], places[q]) for p, q, _, _ in _differing([x[:2] for x in own], [x[:2] for x in other])]
    return out or [(0, ends[-1])]  # only a collision of stored hashes leaves nothing


def _differing(a: list, b: list) -> list[tuple[int, int, int, int]]:
    """Ranges (from, to in ``a``; from, to in ``b``) between equal items in order."""
    return [op[1:] for op in SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if op[0] != "equal"]


def edited(text: str, following: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + following[:n] if n else text


# --- all documents against their edits and neighbours ---------------------

DIGEST = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in DIGEST.split(", ")]
_TYPES = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
_ARROW = [_TYPES[x.split()[1]] for x in DIGEST.split(", ")]
#: Buckets of ids for each shuffle partition, and parts of a hot id's bucket.
BUCKETS, PARTS = 16, 64


def _row(doc_id, text: str, fp: str, following: str, next_fp: str) -> tuple:
    new = edited(text, following)
    new_fp = fp if new == text else fingerprint(new)
    return doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), fp, new_fp, likeness(fp, new_fp), likeness(fp, next_fp)


def _to_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], names=_NAMES)


def bucketed(docs: DataFrame, buckets: int) -> DataFrame:
    """doc_id, text, h (its hash) and a bucket that follows the descending order of
    ids; ids that fill a bucket on their own, null among them, get ``PARTS`` more,
    in the order of h."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    total, cuts = docs.agg(F.count(F.lit(1)), F.percentile_approx("doc_id", [k / buckets for k in range(1, buckets)], 100 * buckets)).first()
    cuts = sorted(set(cuts or []))
    # ids with over a share of all rows: as many as there are buckets at most
    hot = [r.doc_id for r in docs.groupBy("doc_id").count().where(F.col("count") > max(1, total // buckets)).collect()]
    bounds, hot_ids = np.array(cuts, dtype=np.int64), np.array(sorted(x for x in hot if x is not None), dtype=np.int64)
    null_hot = None in hot

    @F.pandas_udf("long")
    def bucket(doc_id: pd.Series, h: pd.Series) -> pd.Series:
        null = doc_id.isna().to_numpy()
        ids = doc_id.fillna(0).to_numpy().astype(np.int64)
        at = len(bounds) - np.searchsorted(bounds, ids, side="left")
        # a hot id lies between the buckets of its neighbours
        below = len(hot_ids) - np.searchsorted(hot_ids, ids, side="left")
        above = len(hot_ids) - np.searchsorted(hot_ids, ids, side="right")
        part = (h.to_numpy().astype(np.int64) >> 32) + (1 << 31)
        part = 1 + part * PARTS // (1 << 32)
        inside = np.where(below > above, part, 0)
        out = (at + below + above) * (PARTS + 2) + inside
        last = (len(bounds) + 2 * len(hot_ids) + 1) * (PARTS + 2)
        return pd.Series(np.where(null, last + (part if null_hot else 0), out))

    return rows.withColumn("bucket", bucket("doc_id", "h"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Digest form: each document with its edited text and its next document.

    One exchange puts a bucket of neighbours into one task.  The first document of
    the bucket after it, whose text is found beforehand, comes along as the last
    row, so each bucket is worked alone.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = bucketed(docs, BUCKETS * n)
    # the first of a bucket: the greatest id, then the least hash, then the least text
    lead = rows.groupBy("bucket").agg(F.max("doc_id").alias("_id")).select(F.col("bucket").alias("_bucket"), "_id")
    firsts = rows.join(F.broadcast(lead), (F.col("bucket") == F.col("_bucket")) & F.col("doc_id").eqNullSafe(F.col("_id")))  # a row a bucket
    least = firsts.groupBy("bucket").agg(F.min("h").alias("_h")).select(F.col("bucket").alias("_b"), "_h")
    heads = firsts.join(F.broadcast(least), (F.col("bucket") == F.col("_b")) & (F.col("h") == F.col("_h"))).groupBy("bucket").agg(F.min("text").alias("text"))
    turn = lead.select(F.col("_bucket").alias("bucket"), F.coalesce(F.lag("_bucket").over(Window.orderBy("_bucket")), F.max("_bucket").over(Window.partitionBy())).alias("before"))
    heads = heads.join(F.broadcast(turn), "bucket").select(F.col("before").alias("bucket"), F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("h"), "text", F.lit(1).alias("kind"))
    dealt = rows.select("bucket", "doc_id", "h", "text", F.lit(0).alias("kind")).union(heads).repartition(n, "bucket")
    dealt = dealt.sortWithinPartitions("bucket", "kind", F.col("doc_id").desc_nulls_last(), "h", F.col("text").asc_nulls_first())

    def run(batches):
        held, out = None, []
        for b in batches:
            for doc_id, text, kind in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                text = text or ""
                fp = fingerprint(text)
                if held is not None:
                    out.append(_row(*held, text, fp))
                held = None if kind else (doc_id, text, fp)
                if len(out) >= 500:
                    yield _to_batch(out)
                    out = []
        if out:
            yield _to_batch(out)

    return dealt.select("doc_id", "text", "kind").mapInArrow(run, DIGEST)
