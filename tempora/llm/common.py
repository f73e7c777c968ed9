"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but the ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one of our own only for a local master."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    where = os.path.join(tempfile.gettempdir(), "checkpoints")
    spark.sparkContext.setCheckpointDir(where)
    return where


#: Folders of the tables written so far, in order.
_WRITTEN: list[str] = []


def mark() -> int:
    """The place from which ``drop_written`` counts."""
    return len(_WRITTEN)


def drop_written(spark: SparkSession, since: int, *kept: DataFrame) -> None:
    """Removes the tables written since that mark but those that ``kept`` read: for steps whose result is written."""
    files = [f for df in kept for f in df.inputFiles()]
    for folder in _WRITTEN[since:]:
        if not any(os.path.basename(folder) in f for f in files):
            _remove(spark, folder)


def free(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of plans that a written table has replaced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bytes of an Arrow batch between the JVM and Python, about: each side holds one or two a task, outside the heap.
BATCH_BYTES = 4 << 20


@contextlib.contextmanager
def small_batches(spark: SparkSession, limit: int = BATCH_BYTES) -> Iterator[None]:
    """Arrow batches of whole texts are bounded by bytes, not only by rows, for what runs meanwhile."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, limit)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def trim() -> None:
    """Gives memory that a task has freed back to the system: idle workers are kept, and count."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts lineage: a lost executor costs at most the stage that runs.  The files go at exit.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tempora-{uuid.uuid4().hex}/{tag}"
    with small_batches(spark):
        df.write.parquet(path)
    folder = path.rpartition("/")[0]
    atexit.register(_remove, spark, folder)
    _WRITTEN.append(folder)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone already
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model learns from (a null id is never held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fold_sql(doc_id: str = "doc_id") -> str:
    return f"coalesce(crc32(cast({doc_id} as string)) % 3 = 1, false)"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the given text column holds about ``limit`` bytes at most, or one row."""
    for batch in batches:
        start, size = 0, 0
        lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        for i, n in enumerate(lengths):
            if size and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if batch.num_rows > start:
            yield batch.slice(start)
    trim()


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", hint: str = "") -> DataFrame:
    """An equi-join in which null keys match, and of whose keys the left ones stay."""
    right = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    right = right.hint(hint) if hint else right
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(right, on, how).drop(*[f"_r_{k}" for k in keys])
