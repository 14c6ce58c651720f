"""Rate limits over the half-open minute before each acquisition, exact to the microsecond.

Batch: ``over_rate`` counts by prefixes over short ranges of time.  Every acquisition
also ends its minute 60 seconds later, so a second holds what is acquired in it and
what expires in it.  The number in the minute before an acquisition is what the last
60 whole seconds hold, from sums a second, plus what came and minus what expired earlier
in its own second.  Windows run within a limiter's second, or over the at most 120 sums of
a limiter's minute, never over a limiter's history.

Stream: ``over_rate_stream`` keeps a ring of seconds for each limiter (a map of second
to its times) and drops what no minute can hold any more.  ``grant_stream`` decides
instead of counting: the i-th call of a limiter starts no earlier than it asks, than
the call before it, and than a minute after the call ``per_minute`` before it; the ring
holds these last ``per_minute`` starts, a slot read and a slot written a call.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

MINUTE, SECOND = 60_000_000, 1_000_000


def in_window(acquisitions: DataFrame) -> DataFrame:
    """``in_window``: acquisitions of the limiter in (ts - 60 s, ts], itself and others at
    the same time among them.  Rows without a time count nowhere and get null."""
    names = acquisitions.columns
    timed = acquisitions.where("ts IS NOT NULL").withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
    come = timed.withColumn("_ends", F.lit(0))
    go = timed.select("limiter", (F.col("_us") + MINUTE).alias("_us"), F.lit(1).alias("_ends"))
    both = come.unionByName(go, allowMissingColumns=True).withColumn("_s", F.expr(f"(_us - pmod(_us, {SECOND})) div {SECOND}"))
    # sums a second, and from them what the seconds before hold
    sums = both.groupBy("limiter", "_s").agg(F.count_if(F.col("_ends") == 0).alias("_in"), F.count_if(F.col("_ends") == 1).alias("_out"))
    minute = Window.partitionBy("limiter", F.expr("(_s - pmod(_s, 60)) div 60")).orderBy("_s")
    before = F.coalesce(F.sum("_in").over(minute.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("_out").over(minute.rowsBetween(0, Window.unboundedFollowing))
    held = sums.select("limiter", "_s", (before + after).alias("_held"), "_in").where("_in > 0").drop("_in")
    second = Window.partitionBy("limiter", "_s").orderBy("_us").rangeBetween(Window.unboundedPreceding, 0)
    own = F.count_if(F.col("_ends") == 0).over(second) - F.count_if(F.col("_ends") == 1).over(second)
    counted = both.withColumn("_own", own).where("_ends = 0").join(held, ["limiter", "_s"])
    counted = counted.select(*names, (F.col("_own") + F.col("_held")).alias("in_window"))
    return counted.unionByName(acquisitions.where("ts IS NULL").withColumn("in_window", F.lit(None).cast("long")))


def over_rate(acquisitions: DataFrame, per_minute: int) -> DataFrame:
    """Acquisitions (limiter, ts, ...) that exceed ``per_minute`` in the minute before."""
    return in_window(acquisitions).where(F.col("in_window") > per_minute)


class OverRate(StatefulProcessor):
    """Rows (limiter, id, ts) that exceed the rate, with the count of their minute.

    Times of a batch are counted with one another; a row up to ``late`` seconds behind
    the newest is counted against what came before it, later ones against what is left.
    """

    def __init__(self, per_minute: int, late: float = 0.0, live: bool = False):
        self.per_minute, self.kept, self.live = per_minute, MINUTE + int(late * SECOND), live

    def init(self, handle: StatefulProcessorHandle) -> None:
        # live: a limiter that falls silent leaves no state behind
        ttl = self.kept // 1000 if self.live else None
        self.ring = handle.getMapState("seconds", "second long", "times binary", ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        new = new[new["ts"].notna()].sort_values("ts", kind="stable")
        if new.empty:
            return
        us = new["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
        had = {k[0]: np.frombuffer(bytes(v[0]), np.int64) for k, v in self.ring.iterator()}
        times = np.sort(np.concatenate([*had.values(), us]))
        count = np.searchsorted(times, us, "right") - np.searchsorted(times, us - MINUTE, "right")
        left = times[times > times[-1] - self.kept]
        seconds = np.unique(left // SECOND)
        for s in had.keys() - set(seconds.tolist()):
            self.ring.removeKey((s,))
        for s in seconds.tolist():
            part = left[np.searchsorted(left, s * SECOND) : np.searchsorted(left, (s + 1) * SECOND)]
            if s not in had or len(part) != len(had[s]):
                self.ring.updateValue((s,), (part.tobytes(),))
        out = new.assign(limiter=key[0], in_window=count)[count > self.per_minute]
        yield out[["limiter", "id", "ts", "in_window"]]

    def close(self) -> None:
        pass


class Grants(StatefulProcessor):
    """Start times of calls (limiter, id, ts) in the order of their times."""

    def __init__(self, per_minute: int):
        self.n = per_minute

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getMapState("starts", "slot long", "us long")
        self.last = handle.getValueState("last", "calls long, us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        new = new[new["ts"].notna()].sort_values(["ts", "id"], kind="stable")
        if new.empty:
            return
        asked = new["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
        calls, before = self.last.get() if self.last.exists() else (0, asked[0])
        slots: dict[int, int] = {}
        starts = []
        for us in asked.tolist():
            slot = calls % self.n
            if slot not in slots and calls >= self.n:
                slots[slot] = self.ring.getValue((slot,))[0]
            before = max(us, before, slots[slot] + MINUTE if calls >= self.n else us)
            slots[slot] = before
            starts.append(before)
            calls += 1
        for slot, us in slots.items():
            self.ring.updateValue((slot,), (us,))
        self.last.update((calls, int(before)))
        start = np.array(starts, dtype="datetime64[us]")
        yield new.assign(limiter=key[0], start=start, waited=(np.array(starts) - asked) / SECOND)[["limiter", "id", "ts", "start", "waited"]]

    def close(self) -> None:
        pass


def over_rate_stream(acquisitions: DataFrame, per_minute: int, late: float = 0.0, live: bool = False) -> DataFrame:
    """``live`` drops a silent limiter's state by processing time; leave it off for replays."""
    p = OverRate(per_minute, late, live)
    return acquisitions.groupBy("limiter").transformWithStateInPandas(p, "limiter string, id long, ts timestamp, in_window long", "Append", "ProcessingTime" if live else "None")


def grant_stream(calls: DataFrame, per_minute: int) -> DataFrame:
    return calls.groupBy("limiter").transformWithStateInPandas(Grants(per_minute), "limiter string, id long, ts timestamp, start timestamp, waited double", "Append", "None")
