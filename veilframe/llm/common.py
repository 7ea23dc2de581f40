"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import gc
import os
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import shared_dir

def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: the lineage ends at files
    that outlive any executor, and later readers prune columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the files behind a table made by cut(), once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {os.path.dirname(p) for p in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of plans that nothing refers to any more, now and not when the driver happens to
    collect its garbage: a loop over stored tables would else fill the executors' disks with those of rounds before."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, most: str = "16m"):
    """Arrow batches of at most so many bytes for what runs within: an executor holds one on either side for each of
    its tasks, beside what the tasks make of it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, most)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ids_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id long, text string): other columns, whatever their names, go no further."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def slices(batches, rows: int = 256):
    """Arrow batches cut into short ones, so that a few very long texts don't pile up as Python objects."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, as UTF-8: bytes.lower() and bytes.split() know ASCII only."""
    return text.encode().lower().split() if text else []


def arrow_schema(**cols: pa.DataType) -> pa.Schema:
    return pa.schema(list(cols.items()))


def default_parallelism(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)
