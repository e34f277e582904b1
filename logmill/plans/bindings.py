"""The supplied tables seen as a partitioned log, a packet stream, a command log and spans.

events: key and stream are user_id, the payload is props; a packet's number is its ordinal among the user's events,
'error' events are lost packets, and a packet arrives at number * INTERVAL_MS + floor(value).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import millis
from ..operators import groups, log, routing

PARTITIONS = 4
INTERVAL_MS, DELAY_MS = 20, 60


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ms", millis("ts"))


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).withColumn("partition", routing.key_modulo(F.col("user_id"), PARTITIONS))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = routed(spark, sf_dir).withColumn("size", F.coalesce(F.octet_length("props"), F.lit(0)).cast("long"))
    return log.assign_offsets(sized, ["ts", "event_id"])


def watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.high_watermarks(routed(spark, sf_dir), PARTITIONS)


def committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups fast and slow have committed 9/10 and 1/2 of each partition; group idle has only registered."""
    share = F.create_map(F.lit("fast"), F.lit(0.9), F.lit("slow"), F.lit(0.5))
    names = spark.createDataFrame([("fast",), ("slow",), ("idle",)], "grp string")
    every = watermarks(spark, sf_dir).crossJoin(F.broadcast(names))  # three rows
    commits = every.filter("grp <> 'idle'").select("partition", "grp", F.floor(F.col("next_offset") * share[F.col("grp")]).alias("next_offset"), F.lit(2).alias("commit_seq"))
    early = commits.select("partition", "grp", F.lit(1).cast("long").alias("next_offset"), F.lit(1).alias("commit_seq"))
    return groups.registered(every.select("partition", "grp"), groups.last_commits(commits.unionAll(early)))


def sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    every = events(spark, sf_dir).withColumn("sequence", number.cast("long"))
    return every.select(F.col("user_id").alias("stream"), "sequence", (F.col("sequence") * INTERVAL_MS + F.floor("value")).alias("arrival_ms"), F.col("props").alias("payload"), "event_type", "value")


def arrived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sent(spark, sf_dir).filter("event_type <> 'error'")


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON commands of a replicated log."""
    kinds = F.create_map(*(F.lit(x) for pair in (("signup", "register_broker"), ("view", "heartbeat"), ("purchase", "create_topic"), ("click", "increment_counter"), ("error", "noop")) for x in pair))
    u = F.col("user_id")
    data = F.to_json(F.struct(kinds[F.col("event_type")].alias("kind"), F.concat(F.lit("t"), u % 20).alias("topic_name"), (u % 5).cast("int").alias("num_partitions"), F.concat(F.lit("b"), u % 30).alias("broker_id"), F.concat(F.lit("host"), u).alias("address")))
    return events(spark, sf_dir).select(F.col("event_id").alias("log_index"), "ms", F.when(F.col("event_id") % 97 == 5, "{broken").otherwise(data).alias("data"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a trace; turn n + 1 is a child of turn (n + 1) / 2."""
    turn = F.col("turn")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("trace_id"), (turn + 1).alias("span_id"), F.expr("(turn + 1) div 2").alias("parent_span_id"), (turn * 10).alias("start_ms"), (turn * 10 + F.coalesce(F.length("text"), F.lit(0)) % 50).alias("end_ms"))
