"""One query per operator over the supplied tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs, scalars
from ..operators import control, estimators, groups, log, membership, metrics, playout, routing
from ..sources import config, segments
from ..sources.storage import file_system, scratch_folder
from ..streaming import processors
from ..streaming.run import all_available
from . import bindings as b

P = b.PARTITIONS
SEGMENT_BYTES, INDEX_BYTES, DAY_MS, HOUR_MS = 4096, 512, 86_400_000, 3_600_000
#: State keys of a stream whose processor takes many streams a key.
BUCKETS = 1024
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _keys(spark, sf):
    return b.table(spark, sf, "orders").select(F.concat(F.lit("key-"), "o_orderkey").alias("k"))


@query
def route_round_robin(spark, sf):
    return routing.round_robin(b.events(spark, sf).select("event_id", "ts"), ["ts", "event_id"], P).select("event_id", "partition")


@query
def route_key_modulo(spark, sf):
    return b.routed(spark, sf).select("event_id", "user_id", "partition")


@query
def route_ring(spark, sf):
    return routing.on_ring(b.events(spark, sf).select("event_id", F.col("user_id").cast("string").alias("k")), "k", list(range(P))).select("event_id", "partition")


@query
def ring_balance(spark, sf):
    return routing.balance(routing.on_ring(_keys(spark, sf), "k", list(range(P))))


@query
def ring_remap_add(spark, sf):
    both = routing.on_ring(routing.on_ring(_keys(spark, sf), "k", list(range(P)), name="before"), "k", list(range(P + 1)), name="after")
    return routing.moved(both, "before", "after")


@query
def ring_remap_remove(spark, sf):
    both = routing.on_ring(routing.on_ring(_keys(spark, sf), "k", list(range(P)), name="before"), "k", [p for p in range(P) if p != 2], name="after")
    return routing.moved(both.filter("before <> 2"), "before", "after")


@query
def modulo_remap(spark, sf):
    both = _keys(spark, sf).select(routing.key_modulo(F.col("k"), P).alias("before"), routing.key_modulo(F.col("k"), P + 1).alias("after"))
    return routing.moved(both, "before", "after")


@query
def assign_offsets(spark, sf):
    return b.event_log(spark, sf).select("event_id", "partition", "offset")


@query
def partition_hwm(spark, sf):
    return b.watermarks(spark, sf)


@query
def point_read(spark, sf):
    return log.read(b.event_log(spark, sf), 1, 5).select("partition", "offset", "event_id", "props")


@query
def range_read(spark, sf):
    return log.read(b.event_log(spark, sf), 2, 10, 29).select("partition", "offset", "event_id", "props")


@query
def poll_limit(spark, sf):
    owned = b.committed(spark, sf).filter(f"grp = 'slow' AND partition % 2 = 0").select("partition", F.col("committed").alias("cursor"))  # noqa: F541
    return groups.poll(b.event_log(spark, sf), owned, 100).select("partition", "offset", "event_id")


def _laid(spark, sf):
    return log.layout(b.event_log(spark, sf), SEGMENT_BYTES, INDEX_BYTES)


@query
def segment_roll(spark, sf):
    return _laid(spark, sf).select("partition", "offset", "segment_base", scalars.segment_name(F.col("segment_base")).alias("segment_file"))


@query
def sparse_index(spark, sf):
    return _laid(spark, sf).filter("indexed").select("partition", "segment_base", "offset", "position")


@query
def segment_metadata(spark, sf):
    return log.segments(_laid(spark, sf))


@query
def valid_prefix(spark, sf):
    return log.valid_prefix(b.event_log(spark, sf), F.col("value") > 250).select("partition", "offset", "event_id")


@query
def crc_audit(spark, sf):
    return b.events(spark, sf).select("event_id", F.crc32("props").alias("crc"))


def _written_log(spark, sf):
    """The log as segment files, through the sink."""
    segments.register(spark)
    whole = b.event_log(spark, sf).select(F.lit("events").alias("topic"), "partition", "offset", F.col("props").alias("payload"))
    return segments.append(whole, scratch_folder(spark, "segments"), SEGMENT_BYTES, INDEX_BYTES)


@query
def segment_files(spark, sf):
    """Writes the log as segment files and reads them back through the source."""
    folder = _written_log(spark, sf)
    return spark.read.format("segments").load(folder).select("topic", "partition", "offset", "len", F.col("payload").cast("string").alias("payload"))


@query
def segment_read_from(spark, sf):
    """The records of one partition from an offset on, found by segment names and the stored index."""
    folder = _written_log(spark, sf)
    return spark.read.format("segments").load(folder).filter("topic = 'events' AND partition = 2 AND offset >= 50").select("partition", "offset", "crc")


@query
def segment_stream(spark, sf):
    """The segment files as a stream."""
    folder = _written_log(spark, sf)
    return all_available(spark.readStream.format("segments").load(folder).select("topic", "partition", "offset", "len"))


def _torn_log(spark, sf):
    """The log on disk; of each partition's second segment the last five bytes are gone."""
    folder = _written_log(spark, sf)
    system, _ = file_system(folder)
    seen: dict[int, int] = {}
    for s in segments.list_segments(folder):
        seen[s.partition] = seen.get(s.partition, 0) + 1
        if seen[s.partition] == 2:
            with system.open_input_stream(s.path) as file:
                blob = file.read()
            with system.open_output_stream(s.path) as file:
                file.write(blob[:-5])
    return folder


@query
def log_recovery(spark, sf):
    """What recovery finds and cuts, by segment."""
    return segments.recover(spark, _torn_log(spark, sf), INDEX_BYTES).withColumn("torn", F.col("torn_bytes") > 0).drop("torn_bytes")


@query
def poll_to_gap(spark, sf):
    """After recovery a reader from offset 0 gets each partition's records up to the first one that was lost."""
    folder = _torn_log(spark, sf)
    segments.recover(spark, folder, INDEX_BYTES).write.format("noop").mode("overwrite").save()
    cursors = spark.range(P).select(F.col("id").cast("int").alias("partition"), F.lit(0).cast("long").alias("cursor"))
    return groups.poll(spark.read.format("segments").load(folder), cursors, 100_000_000).select("partition", "offset")


def _members(spark):
    return spark.createDataFrame([("fast", 2, 0), ("fast", 2, 1), ("slow", 1, 0), ("wide", 3, 0), ("wide", 3, 1), ("wide", 3, 2)], "grp string, group_size int, consumer_index int")


@query
def group_assignment(spark, sf):
    return groups.assignment(_members(spark), P)


@query
def group_lag(spark, sf):
    return groups.lag(b.watermarks(spark, sf), b.committed(spark, sf), 500)


@query
def min_committed(spark, sf):
    return groups.min_committed(b.watermarks(spark, sf), b.committed(spark, sf), 0).drop("blocked")


@query
def backpressure_flag(spark, sf):
    return groups.min_committed(b.watermarks(spark, sf), b.committed(spark, sf).filter("grp <> 'idle'"), 1000)


@query
def admission(spark, sf):
    return groups.admission(b.routed(spark, sf), ["ts", "event_id"], "event_type = 'signup'", 5).select("event_id", "partition", "accepted")


@query
def publish_timeout(spark, sf):
    return groups.publish(b.routed(spark, sf), ["ts", "event_id"], "ms", "event_type = 'signup'", 3, 2 * HOUR_MS).select("event_id", "partition", "published_ms", "outcome")


@query
def delivery_audit(spark, sf):
    whole = b.routed(spark, sf).select("event_id", "partition")
    received = whole.filter("partition % 2 = 0").unionAll(whole.filter("partition % 2 = 1 AND event_id % 50 <> 7")).unionAll(whole.filter("event_id % 100 = 3"))
    return groups.delivery_audit(whole, received, "event_id")


@query
def playout_drain(spark, sf):
    return playout.playout(b.arrived(spark, sf), b.INTERVAL_MS, b.DELAY_MS, drain=True)


@query
def playout_continuous(spark, sf):
    return playout.playout(b.arrived(spark, sf), b.INTERVAL_MS, b.DELAY_MS, drain=False)


@query
def gap_report(spark, sf):
    return playout.gaps(b.arrived(spark, sf))


@query
def late_report(spark, sf):
    return playout.late(b.arrived(spark, sf), b.INTERVAL_MS, b.DELAY_MS)


@query
def last_wins(spark, sf):
    return playout.last_wins(b.events(spark, sf), ["user_id", "event_type"], "event_id", "props")


@query
def conceal_fill(spark, sf):
    return playout.fill_forward(b.events(spark, sf), "user_id", ["ts", "event_id"], "value", "event_type <> 'error'", "good_value").select("event_id", "good_value")


@query
def effective_loss(spark, sf):
    return playout.effective_loss(playout_continuous(spark, sf))


@query
def nack_recovery(spark, sf):
    return playout.recoverable(b.sent(spark, sf), b.arrived(spark, sf), 16)


@query
def sliding_bandwidth(spark, sf):
    sized = b.events(spark, sf).withColumn("bytes", F.floor(F.col("value") * 100))
    return estimators.sliding_rate(sized, "user_id", "ms", "bytes", DAY_MS).select("event_id", F.round("kbps", 6).alias("kbps"))


@query
def ema_loss(spark, sf):
    return estimators.ema(b.events(spark, sf), "user_id", ["ts", "event_id"], (F.col("event_type") == "error").cast("double"), 0.2, "loss").withColumn("loss", F.round("loss", 6))


@query
def ema_rtt(spark, sf):
    return estimators.ema(b.events(spark, sf), "user_id", ["ts", "event_id"], F.col("value"), 0.1, "rtt_ms").withColumn("rtt_ms", F.round("rtt_ms", 6))


@query
def ema_running(spark, sf):
    return estimators.running_ema(b.events(spark, sf), "user_id", ["ts", "event_id"], "value", 0.1, "rtt_ms").select("event_id", F.round("rtt_ms", 6).alias("rtt_ms"))


@query
def bitrate_ladder(spark, sf):
    known = b.events(spark, sf).withColumn("kbps", F.floor(F.col("value") * 20).cast("double")).withColumn("loss", F.when(F.col("event_type") == "error", 1.0).otherwise(0.0))
    return control.rate_ladder(known, "user_id", ["ts", "event_id"], "kbps", "loss").select("event_id", "level", "level_kbps")


def _requests(spark, sf):
    return b.sent(spark, sf).withColumn("ms", F.col("sequence") * 100).withColumn("size", F.floor("value") + 1)


@query
def token_bucket(spark, sf):
    return control.token_bucket(_requests(spark, sf), "stream", ["ms"], "ms", "size", 200.0, 100.0).select("stream", (F.col("ms") / 100).cast("long").alias("sequence"), "accepted")


@query
def priority_drain(spark, sf):
    turn = F.expr("sequence div 10")
    queued = _requests(spark, sf).withColumn("drain_ms", turn * 1000).withColumn("priority", F.when(F.col("event_type").isin("error", "signup"), 0).otherwise(1)).withColumn("kbps", F.element_at(F.array(F.lit(1), F.lit(2), F.lit(4)), (turn % 3 + 1).cast("int")))
    return control.priority_drain(queued, "stream", "drain_ms", "priority", ["sequence"], "size", "kbps").select("stream", "sequence", "priority", "sent")


@query
def adaptive_drain(spark, sf):
    """Drains of ten requests each, at the rate of the level that the drain's own report leads to."""
    turn = F.expr("sequence div 10")
    queued = _requests(spark, sf).withColumn("drain_ms", turn * 1000).withColumn("priority", F.when(F.col("event_type").isin("error", "signup"), 0).otherwise(1)).withColumn("size", F.col("size") * 400)
    reports = queued.groupBy("stream", "drain_ms").agg(F.max(F.floor("value") * 20).alias("kbps"), F.when(F.count_if(F.col("event_type") == "error") >= 4, 1.0).otherwise(0.0).alias("loss"))
    return control.adaptive_drain(queued, reports, "stream", "drain_ms", "priority", ["sequence"], "size", "kbps", "loss").select("stream", "sequence", "priority", "level_kbps", "sent")


@query
def metric_counters(spark, sf):
    return metrics.counters(b.events(spark, sf), "event_type")


@query
def gauge_last(spark, sf):
    return metrics.gauge_last(b.events(spark, sf), "event_type", "value", ["ts", "event_id"])


BOUNDS = (1, 5, 10, 50, 100, 500)


@query
def latency_histogram(spark, sf):
    return metrics.histogram(b.events(spark, sf), "event_type", "value", BOUNDS).withColumn("sum", F.round("sum", 4))


@query
def sampled_latency(spark, sf):
    return metrics.histogram(metrics.sampled(b.events(spark, sf), "event_id"), "event_type", "value", BOUNDS).withColumn("sum", F.round("sum", 4))


@query
def publish_latency(spark, sf):
    """The publish histogram, of values taken as microseconds."""
    e = b.events(spark, sf).withColumn("us", F.floor(F.col("value") * 30))
    return metrics.histogram(e, "event_type", "us", metrics.PUBLISH_BUCKETS)


@query
def prometheus_text(spark, sf):
    e = b.events(spark, sf).withColumn("whole", F.floor("value"))
    named = lambda df, prefix: df.withColumn("name", F.concat(F.lit(prefix), "event_type"))
    return metrics.prometheus(named(metrics.counters(e, "event_type"), "events_total_"), named(metrics.gauge_last(e, "event_type", "whole", ["ts", "event_id"]), "last_value_"), named(metrics.histogram(e, "event_type", "whole", BOUNDS), "value_"))


@query
def raft_stats(spark, sf):
    stats = b.events(spark, sf).select(F.concat(F.lit("n"), F.col("user_id") % 3).alias("node"), F.col("event_type").alias("key"), F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise("never").alias("value"))
    return metrics.numeric_stats(stats, ["click", "view"])


@query
def exact_percentiles(spark, sf):
    return metrics.percentiles(b.events(spark, sf), "event_type", "value", (50, 90, 99, 100))


@query
def throughput(spark, sf):
    return metrics.throughput(b.events(spark, sf), "event_type", "ms")


@query
def span_tree(spark, sf):
    return metrics.span_tree(b.spans(spark, sf)).select("trace_id", "span_id", "depth", "duration_ms")


@query
def span_children(spark, sf):
    return metrics.children(b.spans(spark, sf)).select("trace_id", "span_id", "n_children", "child_ms")


@query
def conversation_gaps(spark, sf):
    return playout.gaps(b.table(spark, sf, "conversations").filter("turn % 3 <> 1").select(F.col("conv_id").alias("stream"), F.col("turn").alias("sequence")))


@query
def liveness(spark, sf):
    e = b.events(spark, sf)
    return membership.liveness(e, "user_id", "ms", e.agg(F.max("ms").alias("now_ms")), DAY_MS)


@query
def sessions(spark, sf):
    return membership.sessions(b.events(spark, sf), "user_id", "ms", 6 * HOUR_MS)


def _commands(spark, sf):
    return membership.parse_commands(b.commands(spark, sf), "data")


@query
def command_replay(spark, sf):
    return membership.replay(_commands(spark, sf))


@query
def topic_registry(spark, sf):
    return membership.topics(_commands(spark, sf))


@query
def topic_lookup(spark, sf):
    """Every third name was never created."""
    asked = spark.range(30).select(F.concat(F.lit("t"), F.when(F.col("id") % 3 == 2, F.col("id") + 1000).otherwise(F.col("id"))).alias("name"))
    return membership.get_topics(asked, topic_registry(spark, sf))


@query
def broker_registry(spark, sf):
    e = b.events(spark, sf)
    return membership.brokers(_commands(spark, sf), e.agg(F.max("ms").alias("now_ms")), DAY_MS)


@query
def replication_lag(spark, sf):
    applied = b.watermarks(spark, sf).select(F.concat(F.lit("n"), "partition").alias("node"), F.col("next_offset").alias("last_index"), F.floor(F.col("next_offset") * 0.9).alias("applied_index"))
    return membership.replication_lag(applied, "n0")


@query
def counter_linearizability(spark, sf):
    return membership.linearizable(b.events(spark, sf).select((F.col("event_id") + 1).alias("v")), "v")


@query
def frame_roundtrip(spark, sf):
    framed = b.sent(spark, sf).withColumn("f", codecs.encode_frame(F.encode("payload", "UTF-8")))
    parts = F.array(F.struct((F.col("sequence") * 2).alias("n"), F.substring("f", 1, 5).alias("c")), F.struct((F.col("sequence") * 2 + 1).alias("n"), F.expr("substring(f, 6)").alias("c")))
    chunks = framed.select("stream", F.explode(parts).alias("p")).select("stream", "p.n", "p.c")
    return codecs.decode_frames(chunks, "stream", "n", "c").withColumn("payload", F.col("payload").cast("string"))


@query
def packet_decode(spark, sf):
    data = F.encode("payload", "UTF-8")
    whole = F.when(F.col("sequence") % 11 == 10, codecs.encode_retransmit(F.col("sequence"))).otherwise(codecs.encode_media(F.col("sequence"), F.col("sequence") * b.INTERVAL_MS, F.col("sequence") % 2, data))
    cut = b.sent(spark, sf).withColumn("w", whole).withColumn("w", F.when(F.col("sequence") % 7 == 6, F.expr("substring(w, 1, octet_length(w) - 1)")).otherwise(F.col("w")))
    d = cut.select("stream", F.col("sequence").alias("sent"), codecs.decode_packet(F.col("w")).alias("p"))
    known = [F.coalesce(f"p.{c}", F.lit(-1)).alias(c) for c in ("sequence", "timestamp_ms", "flags")]
    return d.select("stream", "sent", "p.kind", *known, F.col("p.payload").cast("string").alias("payload"))


@query
def silence_flag(spark, sf):
    samples = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: (F.floor("value") * i * F.when(i % 2 == 0, 1).otherwise(-1)).cast("smallint"))
    return b.events(spark, sf).select("event_id", scalars.is_silent(samples).alias("silent"))


@query
def config_values(spark, sf):
    lines = spark.createDataFrame(list(enumerate(["# comment", "", "port=9092", " name = broker-1 ", "enabled=true", "no value", "port=12abc", "rate=2.5x", "a=b=c"])), "line_no int, line string")
    v = F.col("value")
    return config.parse_config(lines).select("key", "value", scalars.config_int(v, -1).alias("as_int"), scalars.config_bool(v, False).alias("as_bool"), scalars.config_double(v, 0.0).alias("as_double"))


@query
def log_level_filter(spark, sf):
    level = F.element_at(F.array(*map(F.lit, scalars.LEVELS)), (F.col("user_id") % 6 + 1).cast("int"))
    return b.events(spark, sf).withColumn("level", level).filter(scalars.level_at_least(F.col("level"), "warn")).select("event_id", "level")


@query
def prepare_frames(spark, sf):
    """Payloads of 8 equal samples of floor(value) * 2, little-endian."""
    sample = codecs.unsigned(F.floor("value") * 2, 2)
    sent = b.sent(spark, sf).withColumn("payload", F.concat(*[sample] * 8))
    return playout.prepare_frames(sent, b.INTERVAL_MS).select("stream", "sequence", "timestamp_ms", "flags", F.octet_length("packet").cast("long").alias("n_bytes"))


@query
def registry_snapshot(spark, sf):
    counter = _commands(spark, sf).filter("kind = 'increment_counter'").agg(F.count("*").alias("counter"))
    return membership.restore(membership.snapshot(topic_registry(spark, sf), broker_registry(spark, sf), counter))


def _stream(spark, sf):
    """events as a stream, its time stamp in the session's zone. All files are one batch: with more, the rows of a later file
    that are older than the watermark of those before would be dropped as late."""
    schema = b.table(spark, sf, "events").schema
    # a table is a file or a folder of files, any of which the glob names
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{sf}/events.parque[t]")
    return stream.withColumn("ms", scalars.millis("ts")).withColumn("at", F.timestamp_millis("ms"))


@query
def stream_tumbling_counts(spark, sf):
    out = all_available(processors.tumbling_counts(_stream(spark, sf), "at", "event_type", "1 hour", "10 minutes"))
    return out.select(F.unix_millis("window_start").alias("window_start_ms"), "event_type", "n")


@query
def stream_sessions(spark, sf):
    rows = _stream(spark, sf).select("user_id", "ms", "at")
    return all_available(processors.keyed(rows, "user_id", processors.Sessions(6 * HOUR_MS), "at"))


@query
def stream_dedup(spark, sf):
    """Every third event comes twice, and every seventh three times."""
    times = F.when(F.col("event_id") % 7 == 0, 3).when(F.col("event_id") % 3 == 0, 2).otherwise(1)
    again = _stream(spark, sf).withColumn("copy", F.explode(F.sequence(F.lit(1), times)))
    return all_available(processors.dedup(again, "at", ["event_id"], "1 hour").select("event_id", "user_id"))


@query
def stream_ema(spark, sf):
    rows = _stream(spark, sf).select("user_id", "ms", F.col("value").alias("x"))
    return all_available(processors.keyed(rows, "user_id", processors.Ema(0.1))).select("user_id", "ms", F.round("ema", 6).alias("rtt_ms"))


@query
def stream_bandwidth(spark, sf):
    rows = _stream(spark, sf).select("user_id", "ms", F.floor(F.col("value") * 100).cast("long").alias("bytes"))
    return all_available(processors.keyed(rows, "user_id", processors.SlidingRate(DAY_MS))).select("user_id", "ms", F.round("kbps", 6).alias("kbps"))


@query
def stream_playout(spark, sf):
    """The packets as written to a table of their own, played as a stream. A day is added to their times: watermarks begin
    in 1970, so a packet of millisecond 0 would be late."""
    folder = scratch_folder(spark, "packets")
    came = F.col("arrival_ms") + DAY_MS
    b.arrived(spark, sf).select("stream", "sequence", came.alias("arrival_ms"), "payload", F.timestamp_millis(came).alias("at")).write.parquet(f"{folder}/packets")
    rows = spark.readStream.schema("stream long, sequence long, arrival_ms long, payload string, at timestamp").parquet(f"{folder}/packets")
    return all_available(processors.keyed(rows, "stream", processors.Playout(b.INTERVAL_MS, b.DELAY_MS), "at", buckets=BUCKETS))
