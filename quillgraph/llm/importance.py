"""Importance resampling towards a target distribution, on hashed features.

A document's features are its words and, for ``longest`` over 1, its runs of words.
Each feature falls into a bucket by the crc32 of its bytes.  A bucket's gain is the
log ratio of its frequency in the target's texts to that in the corpus, a document's
weight is the mean gain of its features, and the sample holds the documents with the
greatest weight plus Gumbel noise: a draw without replacement with probabilities in
proportion to exp(weight).

The scanner is a byte automaton that steps through whole Arrow batches at once.  A
table of 256 classes turns the buffer's bytes into word bytes and others, borders of
words are where neighbouring classes differ or a document begins, and the table-driven
checksums of all words advance together, a byte of each a step; the words that end
leave the step, and the last few long ones end in one call a word.  Nothing is decoded
and no word becomes a Python object.

Plan: texts are read once, into a table of bucket numbers (two bytes a feature).  From
it come the counts of the buckets (summed in each task first; a fixed number of rows)
and the weights.  The draw is a range sort of the eligible documents by score.

Defined results
* null and empty texts, and texts without words: no features, weight 0.
* null doc_id: noise of the text "2024:", last among ties.  Repeated ids share noise.
* repeated rows: each is scored, drawn and ranked on its own.
* ties of score: smaller doc_id, then fewer features, then smaller weight.
* no target texts: all gains are of absent features.  Empty table: no rows.
* very long texts are scanned whole; other columns take no part, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, give_back, materialize, numbered, sql_crc32

BUCKETS, LONGEST = 10_000, 1
SEED, PERCENT, LEAST_WORDS = 2024, 10, 20
#: Bytes that are scanned at once, and words from which on a step is worth it.
SLICE, FEW = 1 << 21, 8

_BYTES = np.arange(256)
#: A-Z become a-z.
LOWER = np.where((_BYTES >= ord("A")) & (_BYTES <= ord("Z")), _BYTES + 32, _BYTES).astype(np.uint8)
#: Word bytes: digits, letters, and all of code points from 0x80 on.
WORD = (_BYTES >= 0x80) | (_BYTES >= ord("0")) & (_BYTES <= ord("9")) | (LOWER >= ord("a")) & (LOWER <= ord("z"))


def _crc_table() -> np.ndarray:
    t = _BYTES.astype(np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


CRC = _crc_table()
_START = np.uint32(0xFFFFFFFF)


def words_of(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of all words of ``data``; a word never crosses one of ``begins``."""
    mask = WORD[data]
    edge = np.diff(mask.astype(np.int8), prepend=0, append=0)  # 1 where a word starts, -1 after its end
    starts, ends = edge == 1, edge == -1
    cut = begins[(begins > 0) & (begins < len(data))]
    cut = cut[mask[cut] & mask[cut - 1]]
    starts[cut] = ends[cut] = True
    return np.flatnonzero(starts), np.flatnonzero(ends)


def advance(state: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Checksum states after the words' bytes, all words a byte at a time."""
    order = np.argsort(-lengths, kind="stable")
    state, at, lengths = state[order], starts[order], lengths[order]
    longest = int(lengths[0]) if len(lengths) else 0
    # of words longer than j bytes, for each j
    live = len(lengths) - np.cumsum(np.bincount(lengths, minlength=longest + 1))[:longest]
    for j, n in enumerate(live):
        if n <= FEW:
            for k in range(n):
                rest = data[at[k] + j : at[k] + lengths[k]].tobytes()
                state[k] = zlib.crc32(rest, int(state[k]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
            break
        s = state[:n]
        state[:n] = CRC[(s ^ data[at[:n] + j]) & 255] ^ (s >> 8)
    out = np.empty_like(state)
    out[order] = state
    return out


def scan(data: np.ndarray, offsets: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each document, features of each document, crc32 of each feature).

    Document i is ``data[offsets[i]:offsets[i + 1]]``.  Its features are in the order
    of their first words, shorter ones first.
    """
    data = LOWER[data]
    starts, ends = words_of(data, offsets[:-1])
    lengths = ends - starts
    docs = np.searchsorted(offsets, starts, side="right") - 1
    n_docs = len(offsets) - 1
    state = advance(np.full(len(starts), _START), data, starts, lengths)
    crcs, owners, firsts = [state ^ _START], [docs], [np.arange(len(starts))]
    for n in range(1, longest):
        state = state[:-1] if len(state) else state
        state = CRC[(state ^ np.uint32(ord(" "))) & 255] ^ (state >> 8)
        state = advance(state, data, starts[n:], lengths[n:])
        whole = docs[n:] == docs[: len(docs) - n]
        crcs.append((state ^ _START)[whole])
        owners.append(docs[n:][whole])
        firsts.append(np.flatnonzero(whole))
    crc, owner = np.concatenate(crcs), np.concatenate(owners)
    if longest > 1:
        order = np.argsort(np.concatenate(firsts), kind="stable")
        crc, owner = crc[order], owner[order]
    return np.bincount(docs, minlength=n_docs), np.bincount(owner, minlength=n_docs), crc


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty texts."""
    _, where, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(where, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def _slices(offsets: np.ndarray):
    """Ranges of documents of about ``SLICE`` bytes; a longer document stands alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
        yield at, min(to, n)
        at = to


def hashed(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """n_words, n_features and the features' buckets (little-endian numbers of two bytes,
    or four beyond 65,536 buckets) beside the other columns; texts is the last column."""
    width = "<u2" if buckets <= 1 << 16 else "<u4"
    kept = texts.columns[:-1]

    def run(batches):
        for b in batches:
            column = b.column(len(kept))
            if len(column) == 0:
                continue
            data, offsets = _buffers(column)
            for i, j in _slices(offsets):
                part = data[offsets[i] : offsets[j]]
                n_words, n_features, crc = scan(part, offsets[i : j + 1] - offsets[i], longest)
                ids = (crc % np.uint32(buckets)).astype(width)
                ends = np.concatenate([[0], np.cumsum(n_features)]) * ids.itemsize
                # offsets of 64 bits: no limit on the features of a batch
                out = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, j - i) for k in range(len(kept))), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), out.cast(pa.binary())], names=[*kept, "n_words", "n_features", "buckets"])
        give_back()

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[:-1]]
    return texts.mapInArrow(run, ", ".join([*fields, "n_words long, n_features long, buckets binary"]))


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how often each bucket occurs; a task's counts are summed there."""
    width = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for value in b.column(0):
                total += np.bincount(np.frombuffer(value.as_buffer(), width), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    return features.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket, from the counts of both sides."""
    spark = source.sparkSession
    s_all, t_all = ((c.agg(F.sum("n")).first()[0] or 0) for c in (source, target))
    every = spark.range(buckets).withColumnRenamed("id", "bucket")
    both = every.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0)
    one, ratio = F.lit(1.0), None
    ratio = ((F.col("t") + one) * F.lit(float(s_all + buckets))) / ((F.col("s") + one) * F.lit(float(t_all + buckets)))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def weighted(features: DataFrame, gain: np.ndarray, buckets: int = BUCKETS) -> DataFrame:
    """``weight``, the floored mean gain of a document's features, for their buckets."""
    width = "<u2" if buckets <= 1 << 16 else "<u4"
    kept = [c for c in features.columns if c != "buckets"]
    table = gain.astype(np.int64)

    def run(batches):
        for b in batches:
            weights = np.zeros(len(b), np.int64)
            for i, value in enumerate(b.column(len(kept))):
                ids = np.frombuffer(value.as_buffer(), width)
                if len(ids):
                    weights[i] = int(table[ids].sum()) // len(ids)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(kept))), pa.array(weights)], names=[*kept, "weight"])

    fields = [f"`{c}` {features.schema[c].dataType.simpleString()}" for c in kept]
    return features.select(*kept, "buckets").mapInArrow(run, ", ".join([*fields, "weight long"]))


def noise(key, seed: int = SEED):
    """floor(1000 * Gumbel) from the first 32 bits of a keyed digest."""
    digest = F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), "UTF-8"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """A row a document: key, n_words, n_features, weight, score, rank; rank is null
    where the document isn't drawn.  ``target`` holds the target's texts in ``text``."""
    features = materialize(hashed(docs.select(F.col(key), F.col(text)), buckets, longest), "features")
    counted = materialize(bucket_counts(features, buckets), "bucket-counts")
    wanted = materialize(bucket_counts(hashed(target.select(F.lit(0).alias("_"), F.col(text)), buckets, longest), buckets), "target-counts")
    gain = np.zeros(buckets, np.int64)
    for r in gains(counted, wanted, buckets).collect():  # ``buckets`` rows
        gain[r.bucket] = r.gain
    scored = weighted(features, gain, buckets).withColumn("score", F.col("weight") + noise(F.col(key), seed))
    scored = materialize(scored, "scored")
    discard(features, counted, wanted)
    eligible = F.col("n_words") >= least_words
    drawn = percent * scored.where(eligible).count() // 100
    order = [F.col("score").desc(), F.col(key).asc_nulls_last(), F.col("n_features").asc(), F.col("weight").asc()]
    ranked = numbered(scored.where(eligible), order, "place").withColumn("rank", F.when(F.col("place") < drawn, F.col("place") + 1).cast("long"))
    rest = scored.where(~eligible).withColumn("rank", F.lit(None).cast("long"))
    return ranked.drop("place", "part", "at").unionByName(rest)


def resample_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Digest form: documents drawn towards the texts of ``benchmark``."""
    out = resample(docs, benchmark)
    return out.select(*(F.col(c).cast("long").alias(c) for c in ("doc_id", "n_features", "weight", "score", "rank")))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
 f AS (SELECT r, unnest(w) AS w FROM d),
 g AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
 v AS (SELECT w, {sql_crc32("w")} % {BUCKETS} AS b FROM (SELECT w FROM f UNION SELECT w FROM g)),
 s AS (SELECT b, count(*) AS n FROM f JOIN v USING (w) GROUP BY b),
 t AS (SELECT b, count(*) AS n FROM g JOIN v USING (w) GROUP BY b),
 k AS (SELECT b, CAST(floor(1000.0::DOUBLE * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM s) + {BUCKETS})::DOUBLE
    / ((s.n + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM t) + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (b)),
 m AS (SELECT r, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM f JOIN v USING (w) JOIN k USING (b) GROUP BY r),
 c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
    + CAST(floor(-1000.0::DOUBLE * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
    FROM d LEFT JOIN m USING (r)),
 o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place, count(*) OVER (PARTITION BY n_features >= {LEAST_WORDS}) AS n FROM c)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {LEAST_WORDS} AND place <= {PERCENT} * n // 100 THEN place END AS rank FROM o
"""
