"""The partitioned log: offsets, reads, validation, segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import dense_ordinals

RECORD_HEADER = 16
INDEX_BYTES = 4096


def assign_offsets(df: DataFrame, order: list[str], partition: str = "partition") -> DataFrame:
    """Each record's ordinal in its partition, from 0."""
    return dense_ordinals(df, [partition], order, "offset")


def high_watermarks(log: DataFrame, partitions: int) -> DataFrame:
    """Per partition, also an empty one: number of records and next offset. Records that have no offsets yet will get
    dense ones, so their number is the next offset and nothing need be sorted."""
    following = F.max("offset") + 1 if "offset" in log.columns else F.count("*")
    all_parts = log.sparkSession.range(partitions).select(F.col("id").cast("int").alias("partition"))
    seen = log.groupBy("partition").agg(F.count("*").alias("records"), following.alias("next_offset"))
    return all_parts.join(seen, "partition", "left").select("partition", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("next_offset", F.lit(0)).alias("next_offset"))


def read(log: DataFrame, partition: int, first: int, last: int | None = None) -> DataFrame:
    """The record at an offset, or those from ``first`` to ``last``; both conditions reach the scan of a stored log."""
    return log.filter((F.col("partition") == partition) & F.col("offset").between(first, first if last is None else last))


def valid_prefix(log: DataFrame, bad: Column) -> DataFrame:
    """Records before the first bad one of their partition: the least bad offset is one row a partition."""
    first_bad = log.filter(bad).groupBy("partition").agg(F.min("offset").alias("_bad"))
    return log.join(first_bad, "partition", "left").filter("_bad IS NULL OR offset < _bad").drop("_bad")


def layout(log: DataFrame, max_bytes: int, index_bytes: int = INDEX_BYTES, size: str = "size") -> DataFrame:
    """Adds segment_base, position and indexed to (partition, offset, size of the payload).

    A record that would pass ``max_bytes`` opens a segment; one that fits no segment is an error. An index entry
    is due for a segment's first record and after ``index_bytes`` since the last. Both are greedy, so a partition is
    walked in order; its rows stream through in batches, and within a batch whole segments are cut at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, base, at, since = None, 0, 0, 0
        for batch in batches:
            parts, offsets, sizes = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            n = len(parts)
            whole = sizes.astype(np.int64) + RECORD_HEADER
            if n and whole.max() > max_bytes:
                raise ValueError(f"record too large: {whole.max()} bytes in segments of {max_bytes}")
            ends = np.cumsum(whole)
            bases, places, indexed = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
            i = 0
            while i < n:
                stop = int(np.searchsorted(parts[i:], parts[i], side="right")) + i
                if parts[i] != now:
                    now, base, at, since = parts[i], int(offsets[i]), 0, index_bytes
                done = int(ends[i - 1]) if i else 0
                fit = min(stop, int(np.searchsorted(ends, done + max_bytes - at, side="right")))
                if fit == i:  # full: the next segment starts here
                    base, at, since = int(offsets[i]), 0, index_bytes
                    continue
                bases[i:fit] = base
                places[i:fit] = at + ends[i:fit] - whole[i:fit] - done
                k = i
                while k < fit:
                    before = int(ends[k - 1]) if k else 0
                    due = k if since >= index_bytes else int(np.searchsorted(ends, before + index_bytes - since))
                    if due >= fit:
                        since += int(ends[fit - 1]) - before
                        break
                    indexed[due] = True
                    since, k = 0, due + 1
                at += int(ends[fit - 1]) - done
                i = fit
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bases), pa.array(places), pa.array(indexed)], names=["partition", "offset", size, "segment_base", "position", "indexed"])

    rows = log.select(F.col("partition").cast("int"), F.col("offset").cast("long"), F.col(size).cast("long"))
    schema = f"partition int, offset long, {size} long, segment_base long, position long, indexed boolean"
    return rows.repartition("partition").sortWithinPartitions("partition", "offset").mapInArrow(run, schema)


def segments(laid: DataFrame, size: str = "size") -> DataFrame:
    """Per segment: records, bytes, and whether a later one sealed it."""
    each = laid.groupBy("partition", "segment_base").agg(F.count("*").alias("records"), F.sum(F.col(size) + RECORD_HEADER).alias("bytes"))
    last = each.groupBy("partition").agg(F.max("segment_base").alias("_last"))
    return each.join(last, "partition").withColumn("sealed", F.col("segment_base") < F.col("_last")).drop("_last")
