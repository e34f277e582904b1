"""Consumer groups: assignment, commits, lag, admission, delivery."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .ordering import carried, with_ranges

#: Records of a poll that are sorted, and offsets in one of Spark's bitmaps.
SORTED, BITS = 1 << 16, 1 << 15


def assignment(members: DataFrame, partitions: int) -> DataFrame:
    """(grp, group_size, consumer_index) -> the partitions each member owns: partition modulo size is its index."""
    owned = F.filter(F.sequence(F.lit(0), F.lit(partitions - 1)), lambda p: p % F.col("group_size") == F.col("consumer_index"))
    return members.select("grp", "consumer_index", F.explode(owned).alias("partition"))


def last_commits(commits: DataFrame) -> DataFrame:
    """The last commit of each group and partition stands, also if it moves back."""
    return commits.groupBy("partition", "grp").agg(F.max_by("next_offset", "commit_seq").alias("committed"))


def registered(groups: DataFrame, committed: DataFrame) -> DataFrame:
    """(partition, grp) of registered groups with what they committed, 0 if nothing."""
    return groups.join(committed, ["partition", "grp"], "left").withColumn("committed", F.coalesce("committed", F.lit(0)).cast("long"))


def lag(watermarks: DataFrame, committed: DataFrame, max_lag: int) -> DataFrame:
    """lag = max(next_offset - committed, 0); over_limit at the limit or beyond; a limit of 0 is none."""
    joined = committed.join(watermarks.select("partition", "next_offset"), "partition")
    out = joined.withColumn("lag", F.greatest(F.col("next_offset") - F.col("committed"), F.lit(0)))
    return out.withColumn("over_limit", (F.col("lag") >= max_lag) & F.lit(max_lag > 0))


def min_committed(watermarks: DataFrame, committed: DataFrame, max_lag: int) -> DataFrame:
    """Per partition the least commit of its groups, null without groups (and then no limit), and its lag."""
    least = committed.groupBy("partition").agg(F.min("committed").alias("min_committed"))
    out = watermarks.select("partition", "next_offset").join(least, "partition", "left")
    out = out.withColumn("lag", F.greatest(F.col("next_offset") - F.col("min_committed"), F.lit(0)))
    return out.withColumn("blocked", F.coalesce(F.col("lag") >= max_lag, F.lit(False)) & F.lit(max_lag > 0))


def poll(log: DataFrame, cursors: DataFrame, max_records: int) -> DataFrame:
    """Records from each owned partition's cursor on, up to the first missing offset; partitions are drained one after
    another up to the limit.

    Offsets are unique, so a partition offers at most max_records rows from its cursor on: the filter on them reaches
    the log before anything is sorted. Up to SORTED records, they are sorted. Beyond, nothing is: bitmaps of BITS offsets
    tell where each partition's first gap lies, a row for each, and the log is filtered by that.
    """
    near = log.join(F.broadcast(cursors), "partition").filter((F.col("offset") >= F.col("cursor")) & (F.col("offset") < F.col("cursor") + max_records))  # a row a partition
    if max_records > SORTED:
        ends = _limited(_ready(near), max_records)
        return log.join(F.broadcast(ends), "partition").filter((F.col("offset") >= F.col("cursor")) & (F.col("offset") < F.col("cursor") + F.col("_ready"))).drop("cursor", "_ready")
    place = F.row_number().over(Window.partitionBy("partition").orderBy("offset")) - 1
    ready = near.withColumn("_at", place).filter(F.col("offset") - F.col("cursor") == F.col("_at"))
    before = Window.orderBy("partition", "offset")  # at most max_records rows of each owned partition
    return ready.withColumn("_place", F.row_number().over(before)).filter(F.col("_place") <= max_records).drop("_at", "_place", "cursor")


def _ready(near: DataFrame) -> DataFrame:
    """(partition, cursor, _ready): the number of records from the cursor to the first missing offset."""
    nth = F.col("offset") - F.col("cursor") + 1
    maps = near.groupBy("partition", "cursor", F.bitmap_bucket_number(nth).alias("_map")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(nth)).alias("_bits"))
    # whole bytes of ones, and the ones at the low end of the byte after them
    text = F.hex("_bits")
    whole = F.floor((F.length(text) - F.length(F.ltrim(text, F.lit("F")))) / 2).cast("int")
    byte = F.conv(F.substring(text, whole * 2 + 1, F.lit(2)), 16, 10).cast("int")
    ones = F.when(F.bitmap_count("_bits") == BITS, BITS).otherwise(whole * 8 + F.bit_count(byte.bitwiseXOR(byte + 1)) - 1)
    led = maps.select("partition", "cursor", "_map", ones.cast("long").alias("_ones"))
    of = Window.partitionBy("partition").orderBy("_map")  # a row for each BITS offsets
    broken = F.coalesce(F.max(F.col("_ones") < BITS).over(of.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    reached = led.withColumn("_reached", (F.row_number().over(of) == F.col("_map")) & ~broken).filter("_reached")
    return reached.groupBy("partition", "cursor").agg(F.sum("_ones").alias("_ready"))


def _limited(ready: DataFrame, max_records: int) -> DataFrame:
    """Less what is beyond the limit, partitions taken in order: a row for each that is owned."""
    before = F.coalesce(F.sum("_ready").over(Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ready.withColumn("_ready", F.least(F.col("_ready"), F.lit(max_records) - before))


def admission(events: DataFrame, order: list[str], is_commit: str, max_lag: int) -> DataFrame:
    """Publishes and commits in one order per partition; a commit takes all published so far. A publish is accepted
    while fewer than ``max_lag`` were accepted since the last commit. A row whose condition is null is a publish.

    So the number of publishes before a row, less that before the last commit, decides. Both are carried over ranges of
    the order, so a log partition isn't one task.
    """
    commit = F.coalesce(F.expr(is_commit), F.lit(False))
    cut = with_ranges(events, order)
    counted = carried(cut, ["partition"], order, {"_before": ("before", F.when(commit, 0).otherwise(1).cast("long"))})
    since = carried(counted, ["partition"], order, {"_taken": ("last", F.when(commit, F.col("_before")))})
    accepted = F.col("_before") - F.coalesce("_taken", F.lit(0)) < max_lag
    return since.filter(~commit).withColumn("accepted", accepted).drop("_range", "_before", "_taken")


def publish(events: DataFrame, order: list[str], ms: str, is_commit: str, max_lag: int, timeout_ms: int) -> DataFrame:
    """Publishes that wait: (partition, order, ms, published_ms, outcome). A publish that meets max_lag records since the last
    commit waits, in order of arrival, for the next commit that has room for it; after timeout_ms it gives up. outcome:
    published, or timeout (published_ms is then null). A time that is null is that of the row before.

    Who waits depends on who waited before, so a partition is walked in order, as a stream with the waiting rows held.
    """
    names = list(dict.fromkeys(["partition", *order, ms]))
    rows = events.select(*names, F.coalesce(F.expr(is_commit), F.lit(False)).alias("_commit")).repartition("partition").sortWithinPartitions("partition", *order)
    at = names.index(ms)
    schema = StructType([*(events.schema[n] for n in names), StructField("published_ms", LongType()), StructField("outcome", StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, lag, clock, out = object(), 0, 0, []
        waiting: deque[tuple] = deque()  # (deadline, row)

        def give_up(until: float) -> None:
            while waiting and waiting[0][0] <= until:
                out.append((*waiting.popleft()[1], None, "timeout"))

        for batch in batches:
            for *row, commit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != part:
                    give_up(float("inf"))
                    part, lag, clock = row[0], 0, 0
                clock = row[at] if row[at] is not None else clock
                give_up(clock)
                if commit:
                    lag = 0
                    while waiting and lag < max_lag:
                        out.append((*waiting.popleft()[1], clock, "published"))
                        lag += 1
                elif lag < max_lag and not waiting:
                    out.append((*row, clock, "published"))
                    lag += 1
                else:
                    waiting.append((clock + timeout_ms, row))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], schema=arrow)
            out.clear()
        give_up(float("inf"))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], schema=arrow)

    return rows.mapInArrow(run, schema)


def delivery_audit(published: DataFrame, received: DataFrame, key: str) -> DataFrame:
    """Counts of what was published, received, lost, delivered twice, or received though never published."""
    both = published.select(key, F.lit(1).alias("p"), F.lit(0).alias("r")).unionAll(received.select(key, F.lit(0).alias("p"), F.lit(1).alias("r")))
    each = both.groupBy(key).agg(F.sum("p").alias("p"), F.sum("r").alias("r"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return each.agg(total("p").alias("n_published"), total("r").alias("n_received"), F.count_if(F.col("p") > F.col("r")).alias("n_missing"), F.count_if((F.col("r") > F.col("p")) & (F.col("p") > 0)).alias("n_repeated"), F.count_if(F.col("p") == 0).alias("n_unknown"))
