"""Liveness, sessions, topic registry, replicated counter, replication lag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import carried, dense_ordinals, with_ranges

COMMAND = "kind string, topic_name string, num_partitions int, broker_id string, address string"


def liveness(beats: DataFrame, key: str, ms: str, now: DataFrame, timeout_ms: int) -> DataFrame:
    """Per key its last beat and whether less than the timeout has passed since. now: one row, one column now_ms."""
    last = beats.groupBy(key).agg(F.max(ms).alias("last_ms"))
    return last.crossJoin(F.broadcast(now)).select(key, "last_ms", (F.col("now_ms") - F.col("last_ms") < timeout_ms).alias("alive"))  # one row is broadcast


def sessions(events: DataFrame, key: str, ms: str, gap_ms: int) -> DataFrame:
    """(key, session_start, session_end, n): a gap of ``gap_ms`` or more parts sessions. Events without a time are in none.
    A key's events are worked on in ranges of time, so no key is one task."""
    each = events.filter(F.col(ms).isNotNull()).groupBy(key, ms).agg(F.count("*").alias("_n"))
    before = carried(with_ranges(each, [ms]), [key], [ms], {"_before": ("previous", F.col(ms))})
    new = F.coalesce((F.col(ms) - F.col("_before") >= gap_ms).cast("long"), F.lit(1))
    numbered = carried(before.withColumn("_new", new), [key], [ms], {"_s": ("before", F.col("_new"))}).withColumn("_s", F.col("_s") + F.col("_new"))
    return numbered.groupBy(key, "_s").agg(F.min(ms).alias("session_start"), F.max(ms).alias("session_end"), F.sum("_n").alias("n")).drop("_s")


def parse_commands(raw: DataFrame, data: str) -> DataFrame:
    """JSON commands as columns; malformed ones have a null command."""
    return raw.withColumn("command", F.from_json(data, COMMAND)).select("*", "command.*")


def replay(commands: DataFrame, index: str = "log_index") -> DataFrame:
    """Per command of the log its result: value (of the counter; else 0) and error.

    What a command meets depends on the first valid creation of its topic, or the first registration of its broker: a
    row for each of them, looked up by a key that is the command's own where there is nothing to look up. The
    counter's value is the number of increments before, carried over ranges of the log.
    """
    kind, topic, broker = F.col("kind"), F.coalesce("topic_name", F.lit("")), F.coalesce("broker_id", F.lit(""))
    named = lambda tag, name: F.concat(F.lit(tag), name)
    made = commands.filter("kind = 'create_topic' AND num_partitions > 0").select(named("t", topic).alias("_key"), index)
    joined = commands.filter("kind = 'register_broker'").select(named("b", broker).alias("_key"), index)
    first = made.unionAll(joined).groupBy("_key").agg(F.min(index).alias("_first"))
    key = F.when(kind == "create_topic", named("t", topic)).when(kind == "heartbeat", named("b", broker)).otherwise(named("-", F.col(index).cast("string")))
    met = commands.withColumn("_key", key).join(first, "_key", "left")
    error = (
        F.when(kind.isNull(), "malformed command")
        .when((kind == "create_topic") & (F.coalesce("num_partitions", F.lit(0)) <= 0), named("invalid partition count: ", topic))
        .when((kind == "create_topic") & (F.col(index) > F.col("_first")), named("topic already exists: ", topic))
        .when((kind == "heartbeat") & ~F.coalesce(F.col("_first") < F.col(index), F.lit(False)), named("heartbeat on unregistered broker: ", broker))
        .when(~kind.isin("create_topic", "register_broker", "heartbeat", "increment_counter"), named("unknown command kind: ", kind))
    )
    counts = (kind == "increment_counter") & kind.isNotNull()
    judged = met.select(index, "kind", error.alias("error"), F.when(counts, 1).otherwise(0).cast("long").alias("_one"))
    numbered = dense_ordinals(judged, [], [index], "_n", F.col("_one"))
    return numbered.select(index, "kind", F.when(F.col("_one") == 1, F.col("_n") + 1).otherwise(0).alias("value"), "error")


def topics(commands: DataFrame, index: str = "log_index") -> DataFrame:
    """The registry after the log: the first valid creation of each topic stands."""
    valid = commands.filter("kind = 'create_topic' AND num_partitions > 0")
    return valid.groupBy(F.col("topic_name").alias("name")).agg(F.min_by("num_partitions", index).alias("num_partitions"))


def get_topics(names: DataFrame, registry: DataFrame) -> DataFrame:
    """(name) -> (name, num_partitions, error): what the registry has, or an error where it has no such topic."""
    known = names.join(registry, "name", "left")
    return known.select("name", "num_partitions", F.when(F.col("num_partitions").isNull(), F.concat(F.lit("unknown topic: "), "name")).alias("error"))


def brokers(commands: DataFrame, now: DataFrame, timeout_ms: int, index: str = "log_index", ms: str = "ms") -> DataFrame:
    """The members after the log: last address, last sign of life, alive. Beats before registration don't count."""
    beats = commands.filter("kind IN ('register_broker', 'heartbeat')")
    first = beats.filter("kind = 'register_broker'").groupBy("broker_id").agg(F.min(index).alias("_first"), F.max_by("address", index).alias("_address"))
    seen = beats.join(first, "broker_id").filter(F.col(index) >= F.col("_first")).groupBy("broker_id", F.col("_address").alias("address")).agg(F.max(ms).alias("last_ms"))
    return seen.crossJoin(F.broadcast(now)).select("broker_id", "address", "last_ms", (F.col("now_ms") - F.col("last_ms") < timeout_ms).alias("alive"))  # one row is broadcast


def replication_lag(applied: DataFrame, leader: str) -> DataFrame:
    """applied: (node, last_index, applied_index) -> (node, lag) behind the leader's last index, 0 at least."""
    head = applied.filter(F.col("node") == leader).select(F.col("last_index").alias("_last"))
    return applied.join(head, how="cross").select("node", F.greatest(F.col("_last") - F.col("applied_index"), F.lit(0)).alias("lag"))  # one row


def linearizable(values: DataFrame, value: str) -> DataFrame:
    """Whether the values are exactly 1, 2, ..., n."""
    each = values.groupBy(value).agg(F.count("*").alias("_n"))
    total = each.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.count("*").alias("n_distinct"), F.min(value).alias("least"), F.max(value).alias("most"))
    return total.withColumn("linearizable", F.coalesce((F.col("n") == F.col("n_distinct")) & (F.col("least") == 1) & (F.col("most") == F.col("n")), F.col("n") == 0))


def snapshot(topics_: DataFrame, brokers_: DataFrame, counter: DataFrame) -> DataFrame:
    """The state as one JSON text. Registries are metadata: a row a topic and a broker."""
    t = topics_.agg(F.array_sort(F.collect_list(F.struct("name", "num_partitions"))).alias("topics"))
    b = brokers_.agg(F.array_sort(F.collect_list(F.struct("broker_id", "address"))).alias("brokers"))
    return t.join(b, how="cross").join(counter, how="cross").select(F.to_json(F.struct("topics", "brokers", "counter")).alias("state"))  # one row each


def restore(state: DataFrame) -> DataFrame:
    """(kind, name, value) of what a snapshot holds."""
    parsed = state.select(F.from_json("state", "topics array<struct<name: string, num_partitions: int>>, brokers array<struct<broker_id: string, address: string>>, counter long").alias("s"))
    rows = F.concat(
        F.transform("s.topics", lambda t: F.struct(F.lit("topic").alias("kind"), t["name"].alias("name"), t["num_partitions"].cast("string").alias("value"))),
        F.transform("s.brokers", lambda b: F.struct(F.lit("broker").alias("kind"), b["broker_id"].alias("name"), b["address"].alias("value"))),
        F.array(F.struct(F.lit("counter").alias("kind"), F.lit("counter").alias("name"), F.col("s.counter").cast("string").alias("value"))),
    )
    return parsed.select(F.explode(rows).alias("r")).select("r.*")
