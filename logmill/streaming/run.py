"""Runs a stream over what is there now, for the batch comparison and for backfills."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.storage import scratch_folder

ROCKSDB, STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.providerClass"


def started(stream: DataFrame, folder: str) -> StreamingQuery:
    """Writes all input there is to ``folder``/out, exactly once; started again on the same folder it goes on where it
    stopped. State is kept in RocksDB; the session's own setting is as before afterwards."""
    conf = stream.sparkSession.conf
    before = conf.get(STATE_STORE, None)
    conf.set(STATE_STORE, ROCKSDB)  # read when the query starts
    try:
        return stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    finally:
        conf.unset(STATE_STORE) if before is None else conf.set(STATE_STORE, before)


def all_available(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Processes all input there is and reads the result."""
    spark = stream.sparkSession
    folder = folder or scratch_folder(spark, "stream")
    started(stream, folder).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query has dropped as older than its watermark, over its recent batches."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
