"""Plumbing that the operators share: inputs, Arrow buffers, written tables in the shared folder."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


_held: dict[tuple, object] = {}


def hold(key: tuple = (), make: Callable[[], object] | None = None):
    """A worker's tables under a key, made once and kept for later tasks. Only one operator's are kept: another key lets them go."""
    if key not in _held and _held:
        _held.clear()
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):
            pass  # no such call here; the allocator keeps the memory for later
    if make is not None and key not in _held:
        _held[key] = make()
    return _held.get(key)


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) alone, a null text as the empty one; other columns can't clash with ours."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def bounded_batches(spark: SparkSession, size: str = "4m") -> None:
    """Arrow batches are cut by bytes as well as rows, so that long texts can't fill a Python worker."""
    spark.conf.set(BATCH_BYTES, size)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or one of our own where that is unset and Spark is local, as in tests. On a cluster it has to be set."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not set_dir:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        set_dir = given.get() if given.isDefined() else None
    if not set_dir:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        set_dir = "file://" + tempfile.mkdtemp(prefix="tickloom-")
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tickloom/{label}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _file_system(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def materialize(df: DataFrame, label: str, codec: str = "zstd", apart: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage, survives lost executors.

    The table goes with discard(), or else when the driver ends. apart: a boolean column that is not written; the rows where it is true are
    a table of their own, beside() the one returned, so that either can go before the other.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    schema = df.schema if apart is None else df.drop(apart).schema
    out = df.write.option("compression", codec)
    (out if apart is None else out.partitionBy(apart)).parquet(path)
    store, at = _file_system(spark, path)
    store.deleteOnExit(at)
    del df
    release(spark)
    if apart is None:
        return _written(spark, path, schema)
    tables = []
    for part in (f"{path}/{apart}=false", f"{path}/{apart}=true"):
        store.mkdirs(_file_system(spark, part)[1])  # a part without rows has no folder
        tables.append(_written(spark, part, schema))
    tables[0]._tickloom_beside = tables[1]
    return tables[0]


def _written(spark: SparkSession, path: str, schema) -> DataFrame:
    out = spark.read.schema(schema).parquet(path)
    out._tickloom_path = path  # type: ignore[attr-defined]
    return out


def beside(df: DataFrame) -> DataFrame:
    """The table of the rows that materialize() put apart."""
    return df._tickloom_beside  # type: ignore[attr-defined]


def discard(df: DataFrame) -> None:
    """Deletes what materialize() wrote, once nothing reads it any more."""
    path = getattr(df, "_tickloom_path", None)
    if path:
        store, at = _file_system(df.sparkSession, path)
        store.delete(at, True)
        store.cancelDeleteOnExit(at)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string column's bytes (no copy) and its offsets, which begin at 0."""
    wide = "large" in str(column.type)
    buffers = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]
