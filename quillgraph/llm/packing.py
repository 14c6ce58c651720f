"""Hierarchical residual packing of token pieces into fixed-size sequences.

Documents are encoded, closed with an end id, and cut only if they exceed the
capacity: the remainder comes first, then full pieces.  Full pieces are
sequences of their own.  The rest is packed in rounds.

* Round 0 runs inside the encoding tasks: each packs its own pieces best-fit
  decreasing, ``group_items`` at a time.
* In each further round ``fan_in`` neighbouring groups meet.  Their underfull
  bins are items themselves and are packed best-fit again; a merged bin is the
  older one with the younger behind it.  It ends when one group has met all.

A packed group holds one bin at most that is half full or less, as two such bins
would have been one.  So ``fan_in`` groups can save at most ``fan_in`` bins, each
by going into another with enough free places, and only the emptiest bins of a
group can matter: ``fan_in`` for each round still to come.  They go up the tree;
all others are as full as they can get and are emitted.  So every round handles a
bounded number of bins a group, whatever the table's size, and no bin that could
still be saved is left out.

Rounds work on bins (id, size), not on pieces; the pieces learn where their bin
went by one join at the end.

Defined results
* null and empty texts: one piece that holds the end id alone.
* repeated rows: each is packed, with its own place.
* documents longer than the capacity: cut as above, whatever their length.
* empty table: no rows.  Other columns take no part.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import give_back, materialize
from .tokens import encoder

CAPACITY = 1024
END_ID = 2
#: Items that one task packs at a time, and groups that meet in a later round.
GROUP_ITEMS, FAN_IN = 20_000, 16
#: Moved bins (24 bytes each) up to which the last join is a broadcast.
BROADCAST_MOVES = 200_000
#: A task's bins are numbered from its own multiple of this.
TASK_BINS = 1 << 40
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
STATE = PIECE + ", bin long, offset long, size long, flush long"
BINS = "bin long, size long, flush long"
MOVES = "bin long, into long, shift long, size long, flush long"


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best-fit decreasing: (bin of each item, offset in it, fill of each bin).

    Open bins are kept by free space, so each item goes to the fullest bin that
    still takes it; ties go to the older bin.
    """
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    where, offset, fill = [0] * len(sizes), [0] * len(sizes), []
    open_bins: list[tuple[int, int]] = []  # (free, bin)
    for i in order:
        at = bisect_left(open_bins, (sizes[i], -1))
        if at < len(open_bins):
            free, b = open_bins.pop(at)
        else:
            b, free = len(fill), capacity
            fill.append(0)
        where[i], offset[i] = b, fill[b]
        fill[b] += sizes[i]
        if free - sizes[i] > 0:
            insort(open_bins, (free - sizes[i], b))
    return where, offset, fill


def _pieces(doc_ids, texts, tokenizer: str, capacity: int, end_id: int):
    end = np.array([end_id], dtype="<u4").tobytes()
    for doc_id, ids in zip(doc_ids, encoder(tokenizer).encode(texts), strict=True):
        data = ids + end
        n = len(data) // 4
        first = n if n <= capacity else (n % capacity or capacity)
        at, k = 0, 0
        while at < n:
            stop = first if not at else at + capacity
            yield doc_id, k, at, stop - at, zlib.crc32(data[4 * at : 4 * stop])
            at, k = stop, k + 1


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _NAMES]
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


_NAMES = [x.split()[0] for x in STATE.split(", ")]
_TYPES = [{"long": pa.int64(), "int": pa.int32()}[x.split()[1]] for x in STATE.split(", ")]


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = CAPACITY, end_id: int = END_ID, group_items: int = GROUP_ITEMS, fan_in: int = FAN_IN) -> DataFrame:
    """One row a piece: its document, ids' checksum, sequence and place there."""

    def first_round(batches):
        first = TaskContext.get().partitionId() * TASK_BINS
        loose, flushed, used = [], 0, 0

        def packed():
            nonlocal loose, flushed, used
            some, loose = loose, []
            where, offset, fill = best_fit([r[3] for r in some], capacity)
            rows = [(*r, first + used + b, o, fill[b], flushed) for r, b, o in zip(some, where, offset, strict=True)]
            used, flushed = used + len(fill), flushed + 1
            return _batch(rows)

        for b in batches:
            full = []
            for r in _pieces(b.column(0).to_pylist(), b.column(1).to_pylist(), tokenizer, capacity, end_id):
                if r[3] == capacity:
                    full.append((*r, first + used, 0, capacity, None))
                    used += 1
                else:
                    loose.append(r)
                    if len(loose) >= group_items:
                        yield packed()
            if full:
                yield _batch(full)
        if loose:
            yield packed()
        give_back()

    state = materialize(docs.select("doc_id", "text").mapInArrow(first_round, STATE), "pack-pieces")
    pieces = state.select(*[x.split()[0] for x in PIECE.split(", ")], "bin", "offset")
    moves = merge_tree(state.where((F.col("offset") == 0) & (F.col("size") < capacity)), capacity, fan_in)
    if moves is None:
        return pieces
    if moves.count() <= BROADCAST_MOVES:
        moves = F.broadcast(moves)
    moved = pieces.join(moves, "bin", "left")
    return moved.select(*pieces.columns[:-2], F.coalesce("into", "bin").alias("bin"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))


def merge_tree(bins: DataFrame, capacity: int, fan_in: int) -> DataFrame | None:
    """Where underfull bins go: (bin, into, shift), of those that move."""
    bins = bins.select("bin", "size", "flush", F.floor(F.col("bin") / F.lit(TASK_BINS)).alias("task"))
    flushes, tasks = bins.agg(F.max("flush"), F.max("task")).first()
    if flushes is None:
        return None
    # groups are numbered by task, then flush; neighbours meet first
    group = F.col("task") * F.lit(flushes + 1) + F.col("flush")
    groups, rounds = (tasks + 1) * (flushes + 1), 0
    while fan_in**rounds < groups:
        rounds += 1
    bins = bins.select("bin", "size", group.alias("flush"))
    total = None  # of all rounds so far: bin, into, shift
    for level in range(rounds):
        emptiest = Window.partitionBy("flush").orderBy("size", "bin")
        carried = bins.withColumn("_n", F.row_number().over(emptiest)).where(F.col("_n") <= fan_in * (rounds - level)).drop("_n")
        met = carried.withColumn("flush", F.floor(F.col("flush") / F.lit(fan_in)).cast("long"))
        moves = materialize(met.groupBy("flush").applyInPandas(_meet(capacity), MOVES), f"pack-{level}")
        now = moves.where("bin <> into").select("bin", "into", "shift")
        if total is None:
            total = now
        else:  # a bin that took others moves on with them
            again = now.select(F.col("bin").alias("into"), F.col("into").alias("_to"), F.col("shift").alias("_more"))
            total = total.join(again, "into", "left").select("bin", F.coalesce("_to", "into").alias("into"), (F.col("shift") + F.coalesce("_more", F.lit(0))).alias("shift")).union(now)
        bins = moves.where("bin = into AND size < " + str(capacity)).select("bin", "size", "flush")
    return materialize(total, "pack-moves") if total is not None else None


def _meet(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "bin"], ascending=[False, True], kind="stable").reset_index(drop=True)
        where, offset, fill = best_fit(pdf["size"].tolist(), capacity)
        where = np.array(where)
        head = np.zeros(len(fill), dtype=np.int64)
        opens = np.array(offset) == 0
        head[where[opens]] = pdf["bin"].to_numpy()[opens]
        return pd.DataFrame({"bin": pdf["bin"], "into": head[where], "shift": offset, "size": np.array(fill)[where], "flush": pdf["flush"]})

    return run


def pack_documents(docs: DataFrame) -> DataFrame:
    """Digest form: one row a piece."""
    return pack(docs).withColumnRenamed("bin", "sequence_id").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
