"""Structured Streaming counterparts: windows, queue state, watching, usage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    """window_start, event_type, n, total; works on batches and streams alike."""
    e = events.withWatermark("ts", late) if late and events.isStreaming else events
    g = e.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str | None = "10 minutes") -> DataFrame:
    e = events.withWatermark("ts", late) if late and events.isStreaming else events
    g = e.groupBy(F.window("ts", width, step)).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("window.start").alias("window_start"), "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "10 minutes") -> DataFrame:
    e = events.withWatermark("ts", late) if late and events.isStreaming else events
    g = e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def daily_usage(calls: DataFrame, late: str = "1 day") -> DataFrame:
    """UTC-day token totals of call events, each (id, status) once."""
    e = calls.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id", "status"]) if calls.isStreaming else calls.dropDuplicates(["id", "status"])
    g = e.where("status <> 'started'").groupBy(F.window("ts", "1 day")).agg(F.sum(F.coalesce("tokens_in", F.lit(0)) + F.coalesce("tokens_out", F.lit(0))).alias("tokens"))
    return g.select(F.col("window.start").alias("day"), "tokens")


def last_records(log: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Last record of each key; a streaming aggregate in update mode."""
    names = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*names), seq).alias("_r")).select(*keys, "_r.*")


class QueueState(StatefulProcessor):
    """Per-path queue machine: pending, running, done, failed, superseded.

    An input row is a command (path, fingerprint, seq, command, error).  A newer
    fingerprint supersedes an older one; commands of an older version are late
    and only report ``superseded``.  With ``timers`` a failed attempt waits out its
    delay: the job is ``waiting`` until a timer makes it ``pending`` again.
    """

    def __init__(self, max_attempts: int = 5, delay: float = 30.0, timers: bool = False):
        self.max_attempts, self.delay, self.timers = max_attempts, delay, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "fingerprint string, version long, status string, attempts int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        commands = pd.concat(list(rows)).sort_values("seq")
        job = self.state.get() if self.state.exists() else None
        current = list(job) if job is not None else None
        out = []
        for c in commands.itertuples():
            wait = 0.0
            if c.command == "enqueue":
                if current is None or c.seq > current[1] and c.fingerprint != current[0]:
                    if current is not None and current[2] in ("pending", "failed", "running"):
                        out.append((key[0], current[0], "superseded", current[3], 0.0, c.seq))
                    current = [c.fingerprint, c.seq, "pending", 0]
                elif current[2] == "failed":
                    current = [c.fingerprint, current[1], "pending", 0]
            elif current is None or c.fingerprint != current[0]:
                out.append((key[0], c.fingerprint, "superseded", 0, 0.0, c.seq))
                continue
            elif c.command == "claim" and current[2] == "pending":
                current[2], current[3] = "running", current[3] + 1
            elif c.command == "done" and current[2] == "running":
                current[2] = "done"
            elif c.command == "fail" and current[2] == "running":
                current[2] = "failed" if current[3] >= self.max_attempts else "waiting" if self.timers else "pending"
                wait = min(self.delay * 2 ** min(current[3] - 1, 16), 3600.0) if current[2] != "failed" else 0.0
                if current[2] == "waiting":
                    self.handle.registerTimer(timer.getCurrentProcessingTimeInMs() + int(1000 * wait))
            elif c.command == "release" and current[2] == "running":
                current[2], current[3] = "pending", max(current[3] - 1, 0)
            elif c.command == "cancel" and current[2] == "pending":
                current[2] = "cancelled"
            out.append((key[0], current[0], current[2], current[3], wait, c.seq))
        if current is not None:
            self.state.update(tuple(current))
        yield pd.DataFrame(out, columns=["path", "fingerprint", "status", "attempts", "wait", "seq"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        job = list(self.state.get()) if self.state.exists() else None
        if job is not None and job[2] == "waiting":
            job[2] = "pending"
            self.state.update(tuple(job))
            yield pd.DataFrame([(key[0], job[0], "pending", job[3], 0.0, job[1])], columns=["path", "fingerprint", "status", "attempts", "wait", "seq"])

    def close(self) -> None:
        pass


class Watcher(StatefulProcessor):
    """A file's signature (size, mtime) comes out once it stayed for ``settle`` seconds.

    An input row is a sighting (path, size, mtime).  A new signature starts the wait
    anew; one that came out isn't submitted again.
    """

    def __init__(self, settle: float = 10.0):
        self.settle = settle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("file", "size long, mtime double, since long, submitted boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        now = timer.getCurrentProcessingTimeInMs()
        file = self.state.get() if self.state.exists() else None
        for c in pd.concat(list(rows)).itertuples():
            if file is None or (file[0], file[1]) != (c.size, c.mtime):
                file = (int(c.size), float(c.mtime), now, False)
                self.handle.registerTimer(now + int(1000 * self.settle))
        if file is not None:
            self.state.update(tuple(file))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        file = self.state.get() if self.state.exists() else None
        if file is not None and not file[3] and timerValues.getCurrentProcessingTimeInMs() - file[2] >= 1000 * self.settle:
            self.state.update((file[0], file[1], file[2], True))
            yield pd.DataFrame([(key[0], file[0], file[1])], columns=["path", "size", "mtime"])

    def close(self) -> None:
        pass


def watch_stream(sightings: DataFrame, settle: float = 10.0) -> DataFrame:
    return sightings.groupBy("path").transformWithStateInPandas(Watcher(settle), "path string, size long, mtime double", "Update", "ProcessingTime")


class Runs(StatefulProcessor):
    """Consecutive rows of one name form a run; a run comes out when another name
    begins.  Input: (key, name, seq, tokens)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("run", "name string, run long, n long, tokens long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        run = self.state.get() if self.state.exists() else None
        out = []
        for c in pd.concat(list(rows)).sort_values("seq").itertuples():
            if run is not None and run[0] == c.name:
                run = (run[0], run[1], run[2] + 1, run[3] + int(c.tokens))
                continue
            if run is not None:
                out.append((key[0], run[1], run[0], run[2], run[3]))
            run = (c.name, run[1] + 1 if run is not None else 1, 1, int(c.tokens))
        if run is not None:
            self.state.update(tuple(run))
        yield pd.DataFrame(out, columns=["key", "run", "name", "n", "tokens"])

    def close(self) -> None:
        pass


def run_stream(steps: DataFrame) -> DataFrame:
    return steps.groupBy("key").transformWithStateInPandas(Runs(), "key long, run long, name string, n long, tokens long", "Append", "None")


QUEUE_OUT = "path string, fingerprint string, status string, attempts int, wait double, seq long"


def queue_stream(commands: DataFrame, max_attempts: int = 5, delay: float = 30.0, timers: bool = False) -> DataFrame:
    """With ``timers`` backoff ends by itself, in processing time."""
    return commands.groupBy("path").transformWithStateInPandas(QueueState(max_attempts, delay, timers), QUEUE_OUT, "Update", "ProcessingTime" if timers else "None")


def settled(files: DataFrame, settle: str = "10 seconds", late: str = "0 seconds") -> DataFrame:
    """Watched files (path, size, mtime, seen) whose signature stayed for ``settle``.

    A session per signature closes when it wasn't seen anew for the gap: each
    signature comes out once.
    """
    f = files.withWatermark("seen", late) if files.isStreaming else files
    g = f.groupBy(F.session_window("seen", settle), "path", "size", "mtime").agg(F.count(F.lit(1)).alias("sightings"))
    return g.select("path", "size", "mtime", F.col("session_window.end").alias("settled_at"), "sightings")


def drive(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str):
    """Run ``step`` on each micro-batch (dirty keys to an incremental rebuild)."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def collect_once(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run what is available into a memory table, for tests and small results."""
    w = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    (w.option("checkpointLocation", checkpoint) if checkpoint else w).start().awaitTermination()
    return stream.sparkSession.table(name)
