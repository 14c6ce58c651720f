"""Session helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The word definition of the contracts: everything but space, \t, \n, \v, \f, \r.
WORD_SPLIT = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local session, whose tasks run in the driver's process, gets a folder
    of its own where the setting is missing; a cluster without it is refused, as
    executors would write to their own disks.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quillgraph-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def give_back() -> None:
    """At the end of a Python task: return freed memory to the system, as the
    worker process lives on for later tasks beside the executor's heap."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a reread, never a recomputation,
    and everything downstream sees one fixed set of rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Delete materialized tables that nothing reads any more; others are left."""
    for df in frames:
        path = getattr(df, "_written_to", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def row_keyed(docs: DataFrame, name: str = "row") -> DataFrame:
    """``docs`` with an identity of each row, unique also where rows or ids repeat:
    its file and its place there, so reading again gives the same.

    What doesn't come from files is written to the shared folder first.
    """
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    try:
        return docs.withColumn(name, place)
    except AnalysisException:
        return materialize(docs, "rows").withColumn(name, place)


#: Rows of one key up to which a task may have them all.
HOT_ROWS = 10_000


def hot_keys(rows: DataFrame, key: str, total: int) -> list:
    """Keys with over ``HOT_ROWS`` and over a thousandth of all ``total`` rows: a
    thousand of them at most."""
    if total <= HOT_ROWS:
        return []
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(HOT_ROWS, total // 1000))
    return [r[0] for r in counted.select(key).collect()]


def join_apart(rows: DataFrame, per_key: DataFrame, key: str, hot: list) -> DataFrame:
    """``rows`` joined with ``per_key``, a row a key; ``hot`` keys by broadcast, so
    that no task gets all rows of one, the others by shuffle."""
    if not hot:
        return rows.join(per_key, key)
    apart = F.col(key).isin(hot)
    cold = rows.where(~apart).join(per_key.where(~apart), key)
    return cold.unionByName(rows.where(apart).join(F.broadcast(per_key.where(apart)), key))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text):
    """Array column of the words of ``text``; null and blank texts give []."""
    parts = F.split(F.coalesce(text, F.lit("")), WORD_SPLIT)
    return F.filter(parts, lambda w: w != "")


def unsigned_crc32(text):
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def dealt_in_order(rows: DataFrame, order: list, name: str, at_least: int = 1) -> DataFrame:
    """``rows`` as a table with ``part``, the range of ``order`` that they lie in, and
    ``at``, their place there from 0; both are as written and never change.

    Rows that tie in ``order`` are spread by a salt, so they must be alike to the caller.
    """
    n = max(at_least, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = rows.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    dealt = keyed.repartitionByRange(n, *order, "_salt").sortWithinPartitions(*order, "_salt").withColumn("_id", F.monotonically_increasing_id())
    return materialize(dealt.withColumn("part", F.shiftright("_id", 33)).withColumn("at", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id", "_salt"), name)


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """``rows`` with ``name``, their place from 0 in ``order``, and ``part`` and ``at``
    as above: a range sort and a count a range, so no task sees more than a range."""
    dealt = dealt_in_order(rows, order, name)
    counts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("_n"))  # a row a range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.join(F.broadcast(counts.select("part", before.alias("_before"))), "part").withColumn(name, F.col("_before") + F.col("at")).drop("_before")


def sql_crc32(text: str) -> str:
    """DuckDB expression of the unsigned crc32 of a string's UTF-8 bytes."""
    digit = "(strpos('0123456789ABCDEF', substr(hex(encode({0})), {1}, 1)) - 1)"
    codes = f"list_transform(range(1, CAST(length(hex(encode({text}))) AS BIGINT), 2), lambda i: {digit.format(text, 'i')} * 16 + {digit.format(text, 'i + 1')})"
    step = "list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END, xor(s, b))"
    return f"xor(4294967295::BIGINT, list_reduce({codes}, lambda s, b: {step}, 4294967295::BIGINT))"


def blocks_for(n_rows: int, rows_per_block: int, at_least: int = 1) -> int:
    """Blocks of about ``rows_per_block`` rows; grows with the input."""
    return max(at_least, -(-n_rows // rows_per_block))
