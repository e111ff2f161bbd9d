"""Helpers shared by the training-data operators: shared folder, cut tables, memory of workers, size-checked broadcasts, keys of texts."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import itertools
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a table may be broadcast; beyond them the join shuffles.
BROADCAST_BYTES = 32 << 20
#: Bytes that a row takes in a broadcast beside its values, about.
ROW_BYTES = 16
#: Bytes of an Arrow batch of texts, about: Spark's 64 MB would stand several times in the JVM and in the worker.
BATCH_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session (as in tests) gets
    a temporary one, which goes with it; on a cluster that is an error, as executors don't see each other's disks."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tidebar-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: later steps don't recompute it, and lost executors don't lose it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidebar-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


@contextlib.contextmanager
def short_batches(spark: SparkSession, size: int = BATCH_BYTES):
    """What runs inside hands Python workers Arrow batches of `size` bytes at most, about; rows are many or few as they are short or long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release() -> None:
    """Gives this process's freed memory back to the system, as far as Arrow's and the C library's allocators can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def lean(run):
    """run (a function for mapInArrow) that gives memory back when its task is over: the worker stays, beside later steps of the executor."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return task


def settle(spark: SparkSession) -> None:
    """Lets executors drop broadcast tables and shuffle files that nothing refers to any more: Spark drops them when the
    driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop(df: DataFrame) -> None:
    """Deletes a cut table that nothing reads any more, such as what a loop has replaced."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.cut_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, n_rows: int, row_bytes: int | None = None) -> DataFrame:
    """Marks df for broadcasting if its counted rows times their bytes are within the bound; otherwise the join shuffles.

    row_bytes: of a row's values on average; by default the schema's, which is right for columns of fixed width."""
    if row_bytes is None:
        row_bytes = sum(8 if f.dataType.typeName() not in ("string", "binary", "array", "struct", "map") else 40 for f in df.schema)
    return F.broadcast(df) if n_rows * (row_bytes + ROW_BYTES) <= BROADCAST_BYTES else df


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text only, so that extra columns can't clash; a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def text_name(text: Column) -> Column:
    """128 bits of a text's SHA-256, in hex: equal for equal texts."""
    return F.substring(F.sha2(text, 256), 1, 32)


def keyed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with tid: a 64-bit key, equal for equal texts and no others. Keys are drawn anew, with another
    seed, until no two texts of the table share one (by their SHA-256)."""
    for seed in itertools.count():
        tid = F.xxhash64(F.lit(seed), F.sha2("text", 256))
        sha = docs.select(tid.alias("tid"), F.sha2("text", 256).alias("sha")).groupBy("tid").agg(F.min("sha").alias("lo"), F.max("sha").alias("hi"))
        if sha.where("lo <> hi").isEmpty():
            return docs.withColumn("tid", tid)
    raise AssertionError
