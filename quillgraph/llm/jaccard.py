"""Links between texts whose word shingles have a Jaccard similarity of 0.8 or more.

Shingles are five words (of fewer words the whole sequence), compared as sets.

* Candidates share one of ``BANDS`` keys of ``ROWS`` least hashes each: a pair at
  similarity s is missed with probability (1 - s ** ROWS) ** BANDS, 0.0002 at 0.8.
* Equal texts are collapsed first.  In a bucket each text meets an anchor.  In a
  bucket of up to ``SMALL`` texts all pairs are candidates, too, unless anchors
  have joined them already.  A larger one is cut by the next one or two bands' keys
  and treated in the same way.
* The rest is exact: texts of a bucket of over ``SMALL`` that aren't yet all in one
  group meet wherever they share one of their rarest shingles, so many of each text
  that a pair at 0.8 can't miss all (prefix filter); lists of texts with a shingle
  are dealt into cells of bounded size.  Where texts differ in their shingles this is
  linear; where thousands share them and are less similar than 0.8, each pair of
  groups is looked at, but few such pairs become rows (see parity maps).
* Candidates are verified on their shingle sets (32-bit hashes), which a second
  pass takes from the texts that share a bucket, and of no others.
* Where texts meet by shingles, the join compares parity maps first: two maps differ in
  no more bits than the sets in shingles, so only pairs that may be similar become rows.

Defined results: null and blank texts have no links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, give_back, hot_keys, join_apart, materialize
from .components import components
from .simhash import fingerprint

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS, SMALL, LEVELS = 16, 4, 16, 3
#: Texts of one shingle in a block; a cell holds two blocks.
CELL = 1000
#: Words of 64 bits in a text's parity map; it tells little of texts of over 2000 shingles.
WORDS = 16
#: Rows (24 bytes each) up to which a list of texts to read again is broadcast.
BROADCAST_ROWS = 500_000
_rng = np.random.default_rng(42)
_FLIP = _rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)
_ODD = _rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    shingles = {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))}
    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(s) for s in shingles), dtype=np.uint64, count=len(shingles)))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 4096):
        np.minimum(least, ((hashes[at : at + 4096, None] ^ _FLIP) * _ODD).min(0), out=least)
    return np.array([xxhash.xxh3_64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)], dtype=np.uint64).view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def parity_map(hashes: np.ndarray) -> np.ndarray:
    """Words of bits, of which each hash flips one."""
    flips = np.bincount(hashes.astype(np.int64) % (64 * WORDS), minlength=64 * WORDS)
    return np.packbits((flips & 1).astype(np.uint8)).view(np.int64)


def with_keys(docs: DataFrame, keep: list[str], shingle: int = SHINGLE) -> DataFrame:
    """``keep`` columns, ``fp`` of op2, the text's key and its band keys."""
    rows = docs.select(*keep, F.col("text").alias("_text"), F.xxhash64("text").alias("key"))
    schema = rows.select(*keep, F.lit(0).cast("long").alias("fp"), "key", F.array(F.lit(0).cast("long")).alias("bands")).schema

    def run(batches):
        for b in batches:
            fps, bands = [], []
            for text in b.column("_text").to_pylist():
                h = shingle_hashes(text, shingle)
                fps.append(fingerprint(text))
                bands.append(band_keys(h) if len(h) else [])
            columns = [pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), b.column("key"), pa.array(bands, type=pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *columns], names=[*keep, "fp", "key", "bands"])
        give_back()

    return rows.mapInArrow(run, schema)


def _pair(x: str, y: str) -> list:
    return [F.greatest(x, y).alias("a"), F.least(x, y).alias("b")]


def candidates(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct (a, b) keys of ``texts`` (key, bands): each text with its buckets'
    anchors, and the members (bucket, key) of small and of large buckets."""
    turned = lambda k: F.concat(F.slice("bands", k + 1, BANDS - k), F.slice("bands", 1, k))
    z = texts.select("key", F.explode(F.arrays_zip(F.col("bands").alias("x"), turned(1).alias("y"), turned(2).alias("z"))).alias("s"))
    here = materialize(z.select("key", F.col("s.x").alias("k0"), F.xxhash64("s.x", "s.y").alias("k1"), F.xxhash64("s.x", "s.y", "s.z").alias("k2")), "jaccard-bands")
    used, stars, small = [here], [], []
    for level in range(LEVELS):
        k = f"k{level}"
        anchor = F.when(F.count(F.lit(1)) <= SMALL, F.min("key")).otherwise(F.min_by("key", F.xxhash64("key", k)))
        counts = here.groupBy(k).agg(F.count(F.lit(1)).alias("n"), anchor.alias("anchor")).where("n > 1")
        live = materialize(join_apart(here, counts, k, hot_keys(here, k, here.count())), "jaccard-live")
        used.append(live)
        stars.append(live.where("key <> anchor").select(*_pair("key", "anchor")))
        small.append(live.where(F.col("n") <= SMALL).select(F.xxhash64(F.lit(level), k).alias("bucket"), "key"))
        here = live.where(F.col("n") > SMALL).drop("n", "anchor")
        if not level:
            large = materialize(here.select(F.col(k).alias("bucket"), "key"), "jaccard-large")
        if here.isEmpty():
            break
    anchored, few = stars[0], small[0]
    for s, f in zip(stars[1:], small[1:], strict=True):
        anchored, few = anchored.union(s), few.union(f)
    out = materialize(anchored.distinct(), "jaccard-stars"), materialize(few, "jaccard-small"), large
    discard(*used)
    return out


def apart(large: DataFrame, label: DataFrame, sets: DataFrame, least: float) -> DataFrame | None:
    """Pairs (a, b) of texts of ``large`` buckets in two groups of ``label`` that may be
    similar: all that are, and few others.  None where each bucket is of one group."""
    named = large.join(label.select(F.col("node").alias("key"), "component"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    named = materialize(named, "jaccard-named")
    mixed = named.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
    keys = materialize(named.join(mixed, "bucket", "left_semi").select("key", "component").distinct(), "jaccard-apart")
    if keys.isEmpty():
        discard(named, keys)
        return None

    def exploded(batches):
        for b in batches:
            for key, component, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = np.frombuffer(data, np.uint32).astype(np.int64)
                one = lambda x: pa.array(np.full(len(own), x, dtype=np.int64))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([one(key), one(component), one(len(own)), pa.array(own)], names=["key", "component", "size", "shingle"])

    words = [f"w{i}" for i in range(WORDS)]

    def mapped(batches):
        for b in batches:
            maps = np.array([parity_map(np.frombuffer(x, np.uint32)) for x in b.column(1).to_pylist()], dtype=np.int64).reshape(-1, WORDS)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(w)) for w in maps.T)], names=["key", *words])

    rows = materialize(sets.join(keys, "key").select("key", "component", "shingles").mapInArrow(exploded, "key long, component long, size long, shingle long"), "jaccard-shingles")
    df = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    rare = F.row_number().over(Window.partitionBy("key").orderBy("df", "shingle"))
    prefix = join_apart(rows, df, "shingle", hot_keys(rows, "shingle", rows.count())).withColumn("at", rare)
    prefix = materialize(prefix.where(F.col("at") <= F.col("size") - F.ceil(F.lit(least) * F.col("size") - 1e-9) + 1).select("key", "component", "size", "shingle"), "jaccard-prefix")
    lists = prefix.groupBy("shingle").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.ceil(F.count(F.lit(1)) / CELL).alias("blocks")).where("x <> y").select("shingle", "blocks")
    dealt = join_apart(prefix, lists, "shingle", hot_keys(prefix, "shingle", prefix.count())).withColumn("block", F.pmod(F.xxhash64("key", "shingle"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    maps = sets.join(keys, "key", "left_semi").select("key", "shingles").mapInArrow(mapped, ", ".join(f"{c} long" for c in ["key", *words]))
    dealt = dealt.select("shingle", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "key", "component", "size")
    dealt = materialize(dealt.hint("merge").join(maps, "key"), "jaccard-cells")
    # few bytes, much work: the planner must not merge the tasks
    dealt_out = lambda rows: rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shingle", "lo", "hi")
    mate = dealt.select("shingle", "lo", "hi", *(F.col(c).alias(f"_{c}") for c in ("block", "key", "component", "size", *words)))
    alike = (F.col("size") >= F.col("_size") * least - 1e-9) & (F.col("_size") >= F.col("size") * least - 1e-9)
    unlike = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"_{w}"))) for w in words), F.lit(0))
    may = unlike <= (F.col("size") + F.col("_size")) * ((1 - least) / (1 + least)) + 1e-9
    met = dealt_out(dealt).join(dealt_out(mate), ["shingle", "lo", "hi"])
    met = met.where((F.col("key") > F.col("_key")) & (F.col("component") != F.col("_component")) & alike & ((F.col("lo") == F.col("hi")) | (F.col("block") != F.col("_block"))) & may)
    pairs = materialize(met.select(F.col("key").alias("a"), F.col("_key").alias("b")).distinct(), "jaccard-met")
    discard(named, keys, rows, prefix, dealt)
    return pairs


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of ``pairs`` that are similar enough."""
    total = pairs.count()

    def side(rows: DataFrame, name: str) -> DataFrame:
        one = sets.select(F.col("key").alias(name), F.col("shingles").alias(f"set_{name}"))
        return join_apart(rows, one, name, hot_keys(pairs, name, total))

    def run(batches):
        for b in batches:
            ka, kb, sa, sb = (c.to_pylist() for c in b.columns)
            ok = [k for k in range(len(ka)) if jaccard(np.frombuffer(sa[k], np.uint32), np.frombuffer(sb[k], np.uint32)) >= least]
            yield pa.RecordBatch.from_arrays([pa.array([ka[k] for k in ok], type=pa.int64()), pa.array([kb[k] for k in ok], type=pa.int64())], names=["a", "b"])

    both = side(side(pairs, "a"), "b").select("a", "b", "set_a", "set_b")
    return materialize(both.mapInArrow(run, "a long, b long"), "jaccard-verified")


def jaccard_links(rows: DataFrame, docs: DataFrame, least: float = LEAST, shingle: int = SHINGLE) -> DataFrame:
    """Links (a, b) between the fingerprints ``fp`` of similar texts.

    ``rows`` has ``row``, ``fp``, ``key`` and ``bands`` of ``docs`` (row, text).
    """
    texts = materialize(rows.where(F.size("bands") > 0).groupBy("key").agg(F.min("row").alias("row"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "jaccard-texts")
    stars, few, large = candidates(texts.select("key", "bands"))
    asked = stars.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    picked = materialize(texts.join(asked, "key", "left_semi").select("row", "key"), "jaccard-picked")
    found = picked if picked.count() > BROADCAST_ROWS else F.broadcast(picked)

    def sets_of(batches):
        for b in batches:
            sets = [np.unique(shingle_hashes(t, shingle).astype(np.uint32)).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, type=pa.binary())], names=["key", "shingles"])
        give_back()

    sets = materialize(docs.select("row", "text").join(found, "row").select("key", "text").mapInArrow(sets_of, "key long, shingles binary"), "jaccard-sets")
    first = _verified(stars, sets, least)
    # pairs of small buckets that anchors haven't joined
    label = components(first)
    placed = few.join(label.select(F.col("node").alias("key"), "component"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    placed = materialize(placed, "jaccard-placed")
    other = placed.select("bucket", F.col("key").alias("_key"), F.col("component").alias("_component"))
    pairs = placed.join(other, "bucket").where("key > _key AND component <> _component").select(*_pair("key", "_key")).distinct()
    pairs = materialize(pairs, "jaccard-pairs")
    second = _verified(pairs, sets, least)
    found = first.union(second)
    # pairs of large buckets that nothing has joined
    last = None if large.isEmpty() else apart(large, components(found), sets, least)
    third = None if last is None else _verified(last, sets, least)
    found = found if third is None else found.union(third)
    fp = texts.select("key", "fp")
    named = found.join(fp.select(F.col("key").alias("a"), F.col("fp").alias("fp_a")), "a").join(fp.select(F.col("key").alias("b"), F.col("fp").alias("fp_b")), "b")
    out = materialize(named.where("fp_a <> fp_b").select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")).distinct(), "jaccard-links")
    discard(texts, stars, few, large, picked, sets, first, label, placed, pairs, second, last, third)
    return out
