"""Versioned Parquet tables with atomic multi-table commits.

Plain Parquet has no row-level merge, so a change writes the new version of each
table it touches to a directory of its own, and one small manifest, renamed into
place, makes all of them current at once.  Readers hold a manifest's versions: a
snapshot.  Every base write raises the revision and clears the current analysis
run; analysis results are published only if the revision hasn't moved.

Tables of ``BUCKETED`` are kept in buckets of a hash of their key, a directory each;
the manifest names the current directory of every bucket.  A keyed change rewrites
the buckets that its keys fall into and leaves the rest where they are.  A table's
number of buckets grows with its rows (``ROWS_PER_BUCKET``) whenever it is written
whole.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .schema import KEYS, TABLES


#: Tables that grow with the corpus, by the columns whose hash gives the bucket.
BUCKETED: dict[str, list[str]] = {
    "chunks": ["chunk_id"], "chunk_vectors": ["chunk_id"], "chunk_blocks": ["rng"], "mentions": ["chunk_id"], "relation_evidence": ["chunk_id"],
    "relations": ["src_id", "predicate", "dst_id"], "degrees": ["entity_id"],
    "documents": ["doc_id"], "entities": ["entity_id"], "entity_vectors": ["entity_id"], "extraction_cache": ["chunk_id"], "files": ["path"], "stages": ["doc_id"], "llm_usage": ["id"], "messages": ["conversation_id"],
}
ROWS_PER_BUCKET, MOST_BUCKETS = 2_000_000, 4096


class Conflict(RuntimeError):
    """The manifest moved between reading and committing."""


class TableStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # manifest

    def manifest(self) -> dict:
        names = []
        where = self._path(f"{self.root}/_manifest")
        if self._fs.exists(where):
            names = sorted(s.getPath().getName() for s in self._fs.listStatus(where) if s.getPath().getName().endswith(".json"))
        if not names:
            return {"number": 0, "revision": 0, "run_id": None, "tables": {}}
        text = self.spark.read.text(f"{self.root}/_manifest/{names[-1]}", wholetext=True).first()[0]
        return json.loads(text)

    def _publish(self, old: dict, new: dict) -> dict:
        new = new | {"number": old["number"] + 1}
        final = self._path(f"{self.root}/_manifest/{new['number']:012d}.json")
        attempt = self._path(f"{self.root}/_manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(attempt, True)
        out.write(bytearray(json.dumps(new, sort_keys=True).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(attempt, final):
            self._fs.delete(attempt, False)
            raise Conflict(f"manifest {new['number']} exists")
        return new

    @property
    def revision(self) -> int:
        return self.manifest()["revision"]

    # reads

    def read(self, name: str, manifest: dict | None = None) -> DataFrame:
        place = (manifest or self.manifest())["tables"].get(name)
        if place is None:
            return self.spark.createDataFrame([], TABLES[name])
        paths = [place] if isinstance(place, str) else sorted({p for p in place["buckets"] if p})
        if not paths:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*(f"{self.root}/{p}" for p in paths))

    def read_keys(self, name: str, keys: DataFrame, manifest: dict | None = None) -> DataFrame:
        """Rows of ``name`` whose bucket columns are among ``keys``.

        Only the buckets that the keys fall into are opened; their numbers, not the keys,
        come to the driver.  Tables that aren't bucketed are read whole.
        """
        place = (manifest or self.manifest())["tables"].get(name)
        on = BUCKETED.get(name, KEYS[name])
        wanted = keys.select(*on).distinct()
        if place is None or isinstance(place, str) or len(place["buckets"]) == 1:
            return self.read(name, manifest).join(wanted, on, "left_semi")
        n = len(place["buckets"])
        hit = [r[0] for r in wanted.select(bucket_of(name, n).alias("b")).distinct().collect()]  # n at most
        paths = sorted(f"{self.root}/{place['buckets'][k]}" for k in hit if place["buckets"][k])
        if not paths:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*paths).join(wanted, on, "left_semi")

    def expire(self, keep: int = 10) -> int:
        """Delete manifests but the last ``keep``, and the directories of tables and of
        buckets that none of these names; the number of directories deleted.

        A directory that a commit under way has written is named by no manifest yet: run
        this when nothing is written, or after writers that began before have ended.
        """
        where = self._path(f"{self.root}/_manifest")
        if not self._fs.exists(where):
            return 0
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(where) if s.getPath().getName().endswith(".json"))
        held: set[str] = set()
        for name in names[-max(1, keep) :]:
            tables = json.loads(self.spark.read.text(f"{self.root}/_manifest/{name}", wholetext=True).first()[0])["tables"]
            for place in tables.values():
                held |= {p for p in ([place] if isinstance(place, str) else place["buckets"]) if p}
        versions, gone = {"/".join(p.split("/")[:2]) for p in held}, 0
        for table in self._fs.listStatus(self._path(self.root)):
            if not table.isDirectory() or table.getPath().getName().startswith("_"):
                continue
            for version in self._fs.listStatus(table.getPath()):
                path = f"{table.getPath().getName()}/{version.getPath().getName()}"
                if path not in versions:
                    gone += bool(self._fs.delete(version.getPath(), True))
                    continue
                inner = self._path(f"{self.root}/{path}/in")
                for bucket in self._fs.listStatus(inner) if self._fs.exists(inner) else []:
                    if bucket.isDirectory() and f"{path}/in/{bucket.getPath().getName()}" not in held:
                        gone += bool(self._fs.delete(bucket.getPath(), True))
        for name in names[: -max(1, keep)]:
            self._fs.delete(self._path(f"{self.root}/_manifest/{name}"), False)
        return gone

    def exists(self, name: str) -> bool:
        return name in self.manifest()["tables"]

    # writes

    def commit(self, changes: dict[str, DataFrame], *, base: bool = True, expected: int | None = None, run_id: str | None = None) -> dict:
        """Make ``changes`` (whole new contents) current together.

        ``expected`` compares and sets: the commit fails if the revision moved.
        """
        old = self.manifest()
        if expected is not None and old["revision"] != expected:
            raise Conflict(f"revision is {old['revision']}, expected {expected}")
        tables = dict(old["tables"])
        for name, df in changes.items():
            tables[name] = self._write(name, df, old["number"] + 1)
        return self._publish(old, {"revision": old["revision"] + base, "run_id": None if base else (run_id or old["run_id"]), "tables": tables})

    def _typed(self, name: str, df: DataFrame) -> DataFrame:
        return df.select([F.col(f.name).cast(f.dataType) for f in self.spark.createDataFrame([], TABLES[name]).schema])

    def _write(self, name: str, df: DataFrame, number: int, buckets: int | None = None, only: list[int] | None = None) -> str | dict:
        """Write ``df``; a bucketed table as {"buckets": [directory or None, ...]}."""
        path = f"{name}/v={number:012d}-{uuid.uuid4().hex[:8]}"
        rows = self._typed(name, df)
        if name not in BUCKETED:
            rows.write.parquet(f"{self.root}/{path}")
            return path
        if buckets is None:
            plain = f"{self.root}/{path}/all"
            rows.write.parquet(plain)
            n = self.spark.read.schema(TABLES[name]).parquet(plain).count()
            if n <= ROWS_PER_BUCKET:
                return {"buckets": [f"{path}/all"]}
            buckets = min(MOST_BUCKETS, -(-n // ROWS_PER_BUCKET))
            rows = self.spark.read.schema(TABLES[name]).parquet(plain)
        dealt = rows.withColumn("_bucket", bucket_of(name, buckets))
        dealt.repartition(min(buckets, 4096), "_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{path}/in")
        there = {int(s.getPath().getName().split("=")[1]) for s in self._fs.listStatus(self._path(f"{self.root}/{path}/in")) if "=" in s.getPath().getName()}
        if only is None:
            self._fs.delete(self._path(f"{self.root}/{path}/all"), True)
        return {"buckets": [f"{path}/in/_bucket={k}" if k in there else None for k in range(buckets)]}

    def merge(self, changes: dict[str, tuple[DataFrame, DataFrame]], *, base: bool = True) -> dict:
        """Keyed changes of several tables, current together.

        A table's change is (gone, rows): all rows that share ``gone``'s columns go,
        then ``rows`` are added.  ``gone`` must hold the bucket columns of a bucketed
        table, so only the buckets that it or ``rows`` fall into are rewritten.
        """
        old = self.manifest()
        tables = dict(old["tables"])
        for name, (gone, rows) in changes.items():
            tables[name] = self._merged(name, tables.get(name), gone, rows, old["number"] + 1)
        return self._publish(old, {"revision": old["revision"] + base, "run_id": None if base else old["run_id"], "tables": tables})

    def _merged(self, name: str, place, gone: DataFrame, rows: DataFrame, number: int):
        on, rows = gone.columns, self._typed(name, rows)
        now = lambda paths: self.spark.read.schema(TABLES[name]).parquet(*(f"{self.root}/{p}" for p in paths)) if paths else self.spark.createDataFrame([], TABLES[name])
        if place is None:
            return self._write(name, rows, number)
        if isinstance(place, str) or len(place["buckets"]) == 1 or not set(BUCKETED[name]) <= set(on):
            before = now([place] if isinstance(place, str) else [p for p in place["buckets"] if p])
            return self._write(name, before.join(gone.distinct(), on, "left_anti").unionByName(rows), number)
        buckets = list(place["buckets"])
        n = len(buckets)
        keys = BUCKETED[name]
        hit = sorted(r[0] for r in gone.select(*keys).union(rows.select(*keys)).select(bucket_of(name, n).alias("b")).distinct().collect())  # n at most
        touched = [buckets[k] for k in hit if buckets[k]]
        kept = now(touched).join(gone.distinct(), on, "left_anti").unionByName(rows) if touched else rows
        fresh = self._write(name, kept, number, n, hit)["buckets"]
        for k in hit:
            buckets[k] = fresh[k]
        return {"buckets": buckets}

    def upserted(self, name: str, rows: DataFrame) -> DataFrame:
        return upsert(self.read(name), rows, KEYS[name])

    def upsert(self, name: str, rows: DataFrame) -> dict:
        fresh = last_of_each(rows, KEYS[name])
        return self.merge({name: (fresh.select(*KEYS[name]), fresh)})

    def insert_absent(self, name: str, rows: DataFrame) -> dict:
        old = self.read(name)
        return self.commit({name: old.unionByName(rows.dropDuplicates(KEYS[name]).join(old, KEYS[name], "left_anti"), allowMissingColumns=True)})

    def delete(self, name: str, keys: DataFrame, on: list[str] | None = None) -> dict:
        return self.commit({name: self.read(name).join(keys, on or KEYS[name], "left_anti")})

    def replace_where(self, name: str, rows: DataFrame, on: list[str], scope: DataFrame | None = None) -> dict:
        """Replace all rows that share ``on`` with ``scope`` (default: with rows)."""
        gone = (scope if scope is not None else rows).select(*on).distinct()
        return self.commit({name: self.read(name).join(gone, on, "left_anti").unionByName(rows, allowMissingColumns=True)})

    def wipe(self) -> dict:
        old = self.manifest()
        return self._publish(old, {"revision": old["revision"] + 1, "run_id": None, "tables": {}})

    def publish_analysis(self, expected: int, entities: DataFrame, run_id: str) -> bool:
        """Set analysis columns unless the base tables changed meanwhile."""
        try:
            self.commit({"entities": entities}, base=False, expected=expected, run_id=run_id)
        except Conflict:
            return False
        return True


def bucket_of(name: str, buckets: int):
    return F.pmod(F.xxhash64(*BUCKETED[name]), F.lit(buckets)).cast("int")


def last_of_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key: the last by ``seq`` if there is such a column, else the
    greatest by its other columns, so that reruns agree."""
    names = [c for c in rows.columns if c not in keys]
    if not names:
        return rows.distinct()
    order = F.struct("seq", *[n for n in names if n != "seq"]) if "seq" in names else F.struct(*names)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*names), order).alias("_r")).select(*keys, "_r.*")


def upsert(old: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keyed merge: the last of ``rows`` for a key wins over ``old``.

    Only the keys of the old side are compared, so its other columns aren't
    shuffled twice: an anti-join and a union.
    """
    fresh = last_of_each(rows, keys)
    return old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def latest(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row of greatest ``seq`` for each key."""
    w = Window.partitionBy(*keys).orderBy(F.col(seq).desc())
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
