"""Helpers that the training-data operators share: reading, scratch tables, Arrow plumbing."""

from __future__ import annotations

import contextlib
import ctypes
import os
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import partitions_for, scratch_folder

#: Stands in for a null id inside the operators; results carry null again.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of texts that go to Python in one Arrow batch, and the session's setting of it.
BATCH_BYTES, BATCH_KEY = "3m", "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of the input for each of the partitions that texts are shuffled to.
PARTITION_BYTES = 64 << 20


def small_batches(spark: SparkSession) -> None:
    """For applications: a session whose Arrow batches have Spark's default size gets smaller ones, as its tasks hold
    several of them. Operators leave the session as it is; any size gives the same rows."""
    if spark.conf.get(BATCH_KEY) in ("64MB", "67108864b", "67108864"):
        spark.conf.set(BATCH_KEY, BATCH_BYTES)


def text_partitions(df: DataFrame) -> int:
    """Shuffle partitions for the texts of ``df``: the session's, more for an input of over PARTITION_BYTES for each."""
    return partitions_for(df, PARTITION_BYTES)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes ``df`` to the shared folder and reads it back."""
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_ids(df: DataFrame, id_col: str) -> DataFrame:
    """Null ids become NULL_ID, so that they sort first and compare like any other id."""
    return df.withColumn(id_col, F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)))


def null_ids(col: str) -> F.Column:
    return F.when(F.col(col) != F.lit(NULL_ID), F.col(col)).alias(col)


def per_worker(key, make: Callable):
    """What ``make`` gave for this key, kept for later tasks of the same Python worker; one thing at a time."""
    store = sys.__dict__.setdefault("_logmill_per_worker", {})
    if key not in store:
        if store:
            store.clear()
            release_memory()
        store[key] = make()
    return store[key]


def release_memory() -> None:
    """Gives memory that Python and Arrow have freed back to the machine, so that a worker that is kept is small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows, so that few texts are Python objects at once."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def summed(parts: DataFrame, add: Callable[[list[bytes]], bytes], fan: int = 256) -> DataFrame:
    """(slice, blob) with a blob a task -> (slice, blob) with the sum of all, in as many rounds as it takes to have at most
    ``fan`` blobs in a group. ``add`` gives the sum of some blobs as a blob."""

    def one(table: pa.Table) -> pa.Table:
        total = add([b.as_buffer() for b in table.column("blob")])
        return pa.table({"slice": table.column("slice")[:1], "part": table.column("part")[:1], "blob": pa.array([total], pa.binary())})

    out, n, fan = "slice int, part long, blob binary", parts.rdd.getNumPartitions(), max(2, fan)
    parts = parts.select(F.col("slice").cast("int").alias("slice"), F.spark_partition_id().cast("long").alias("part"), "blob")
    while n > fan:
        n = -(-n // fan)
        parts = parts.withColumn("part", F.floor(F.col("part") / fan)).groupBy("slice", "part").applyInArrow(one, out)
    return parts.groupBy("slice").applyInArrow(one, out).select("slice", "blob")


def byte_texts(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer files lie on this machine; LOGMILL_TOKENIZERS names another folder."""
    folder = os.environ.get("LOGMILL_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))
