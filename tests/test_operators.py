"""Operators on small literal inputs."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from logmill.functions import codecs, scalars
from logmill.operators import control, estimators, groups, log, membership, metrics, ordering, playout, routing
from logmill.sources import segments
from logmill.sources.config import parse_config, with_environment
from logmill.streaming import processors
from logmill.streaming.run import all_available


def rows(df, *columns):
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=str)


def test_keyed_order_and_offsets(spark):
    df = spark.createDataFrame([(i, "session-A" if i % 3 else f"k{i}") for i in range(300)], "seq long, key string").repartition(7)
    out = log.assign_offsets(df.withColumn("partition", routing.key_modulo(F.col("key"), 4)), ["seq"]).collect()
    assert len({r["partition"] for r in out if r["key"] == "session-A"}) == 1
    for p in range(4):
        mine = sorted((r for r in out if r["partition"] == p), key=lambda r: r["seq"])
        assert [r["offset"] for r in mine] == list(range(len(mine)))


def test_ordinals_with_nulls_and_ties(spark):
    df = spark.createDataFrame([(None, i) for i in range(5)] + [(1.0, i) for i in range(20)] + [(2.0, 0)], "v double, id int")
    assert sorted(r["n"] for r in ordering.dense_ordinals(df, [], ["v", "id"], "n").collect()) == list(range(26))
    assert ordering.dense_ordinals(df.filter("false"), [], ["v", "id"], "n").count() == 0


def test_ring_properties(spark):
    keys = spark.range(10_000).select(F.concat(F.lit("key-"), "id").alias("k"))
    shares = {r["partition"]: r["share"] for r in routing.balance(routing.on_ring(keys, "k", [0, 1, 2, 3])).collect()}
    assert len(shares) == 4 and all(abs(s - 0.25) < 0.1 for s in shares.values())
    both = routing.on_ring(routing.on_ring(keys, "k", [0, 1, 2, 3], name="before"), "k", [0, 1, 2, 3, 4], name="after")
    assert both.count() == 10_000 and routing.moved(both, "before", "after").first()["fraction"] < 0.4
    assert both.filter("before <> after AND after <> 4").count() == 0


def brute_layout(sizes, limit, index):
    out, base, used, since = [], 0, 0, index
    for i, s in enumerate(sizes):
        if used + 16 + s > limit:
            base, used, since = i, 0, index
        position, used = used, used + 16 + s
        if since >= index or since + 16 + s >= index:
            indexed, since = True, 0
        else:
            indexed, since = False, since + 16 + s
        out.append((i, base, position, indexed))
    return out


@pytest.mark.parametrize("limit,index", [(300, 100), (64, 4096), (4096, 90)])
def test_layout_over_batches(spark, limit, index):
    rng = random.Random(limit)
    sizes = [rng.randrange(48) for _ in range(500)]
    df = spark.createDataFrame([(0, i, s) for i, s in enumerate(sizes)] + [(1, i, s) for i, s in enumerate(sizes[::-1])], "partition int, offset long, size long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        got = log.layout(df, limit, index).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for p, mine in ((0, sizes), (1, sizes[::-1])):
        assert sorted((r["offset"], r["segment_base"], r["position"], r["indexed"]) for r in got if r["partition"] == p) == brute_layout(mine, limit, index)


def test_record_too_large(spark):
    with pytest.raises(Exception, match="record too large"):
        log.layout(spark.createDataFrame([(0, 0, 100)], "partition int, offset long, size long"), 64).collect()


def test_torn_segment(spark, tmp_path):
    folder = tmp_path / "events" / "partition-0"
    folder.mkdir(parents=True)
    blob = bytearray(segments.encode_record(0, b"intact record") + segments.encode_record(1, b"this one will be corrupted"))
    blob[45] = 0xFF
    (folder / f"{0:020d}.seg").write_bytes(bytes(blob))
    (folder / f"{2:020d}.seg").write_bytes(segments.encode_record(2, b"") + segments.encode_record(3, b"x") + bytes(64))
    segments.register(spark)
    df = spark.read.format("segments").load(f"file://{tmp_path}")
    assert rows(df, "offset", "payload") == [(0, bytearray(b"intact record")), (2, bytearray(b"")), (3, bytearray(b"x"))]
    assert df.filter("offset = 3").first()["crc"] == zlib.crc32(b"x")
    assert [p.base for p in _pruned(f"file://{tmp_path}", offset=3)] == [2]
    assert spark.read.format("segments").load(f"file://{tmp_path}/none").count() == 0


def _pruned(folder, offset):
    from pyspark.sql.datasource import EqualTo

    reader = segments.SegmentReader(folder)
    list(reader.pushFilters([EqualTo(("offset",), offset)]))
    return reader.partitions()


def test_segment_stream_and_random_round_trip(spark, tmp_path):
    rng = random.Random(42)
    data = [(0, i, bytes(rng.randrange(256) for _ in range(rng.randrange(1, 200)))) for i in range(400)]
    df = spark.createDataFrame(data, "partition int, offset long, payload binary").withColumn("size", F.octet_length("payload"))
    laid = log.layout(df, 4096).join(df.drop("size"), ["partition", "offset"])
    assert segments.write_segments(laid, f"file://{tmp_path}/log", "t").agg(F.sum("records")).first()[0] == 400
    segments.register(spark)
    got = {r["offset"]: bytes(r["payload"]) for r in spark.read.format("segments").load(f"file://{tmp_path}/log").collect()}
    assert got == {i: p for _, i, p in data}
    stream = spark.readStream.format("segments").load(f"file://{tmp_path}/log").select("offset")
    assert sorted(r["offset"] for r in all_available(stream).collect()) == list(range(400))


def test_a_log_partition_is_written_by_many_tasks(spark, tmp_path):
    """It was one task's. Segments are cut as the sink cuts, over batches and logs, and appended to a log that is there."""
    rng = random.Random(11)
    data = [(t, p, i, rng.choice([None, b"", bytes(rng.randrange(1, 48))]) if i else b"first") for t in ("a", "b") for p in (0, 1) for i in range(500)]
    df = spark.createDataFrame(data, "topic string, partition int, offset long, payload binary")
    want = set()
    for log_of in {r[:2] for r in data}:
        sizes = [len(r[3] or b"") for r in data if r[:2] == log_of]
        want |= {(*log_of, offset, base) for offset, base, *_ in brute_layout(sizes, 300, 100)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = segments.arranged(df, 300).withColumn("task", F.spark_partition_id()).collect()
        segments.register(spark)
        folder = segments.append(df.filter("offset < 400"), f"file://{tmp_path}/log", 300)
        segments.append(df.filter("offset >= 400"), folder, 300)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r["topic"], r["partition"], r["offset"], r["segment_base"]) for r in placed} == want and len(placed) == len(data)
    tasks = {}
    for r in placed:
        tasks.setdefault((r["topic"], r["partition"]), set()).add(r["task"])
    assert all(len(of_log) > 1 for of_log in tasks.values())
    assert rows(spark.read.format("segments").load(folder), "topic", "partition", "offset", "payload") == sorted(((t, p, i, bytearray(b or b"")) for t, p, i, b in data), key=str)
    with pytest.raises(Exception, match="record too large"):
        segments.append(df, f"file://{tmp_path}/small", 40)


def test_groups(spark):
    hwm = spark.createDataFrame([(0, 20, 20), (1, 0, 0)], "partition int, records long, next_offset long")
    one = spark.createDataFrame([(0, "g", 0), (1, "g", 0)], "partition int, grp string, committed long")
    assert [r["over_limit"] for r in groups.lag(hwm, one, 20).orderBy("partition").collect()] == [True, False]
    assert not any(r["over_limit"] for r in groups.lag(hwm, one, 0).collect())
    none = groups.min_committed(hwm, one.filter("false"), 5).collect()
    assert all(r["min_committed"] is None and not r["blocked"] for r in none)
    moved = spark.createDataFrame([(0, "g", 9, 1), (0, "g", 4, 2)], "partition int, grp string, next_offset long, commit_seq long")
    assert rows(groups.last_commits(moved)) == [(0, "g", 4)]
    publishes = spark.createDataFrame([(i, 0, "c" if i == 30 else "p") for i in range(60)], "n int, partition int, kind string")
    accepted = groups.admission(publishes, ["n"], "kind = 'c'", 20)
    assert accepted.filter("accepted").count() == 40 and accepted.filter("n < 30 AND accepted").count() == 20


def test_publish_waits_or_gives_up(spark):
    kinds = "ppp" + "pp" + "c" + "ppp" + "c"  # a lag of two: the third waits, and so on
    df = spark.createDataFrame([(0, i, 10 * i, k) for i, k in enumerate(kinds)] + [(1, 0, 5, "p"), (1, 1, None, "p"), (1, 2, 6, "p")], "partition int, n int, ms long, kind string")
    got = {(r["partition"], r["n"]): (r["published_ms"], r["outcome"]) for r in groups.publish(df, ["n"], "ms", "kind = 'c'", 2, 35).collect()}
    p, t = "published", "timeout"
    assert got == {(0, 0): (0, p), (0, 1): (10, p), (0, 2): (50, p), (0, 3): (50, p), (0, 4): (None, t), (0, 6): (90, p), (0, 7): (90, p), (0, 8): (None, t), (1, 0): (5, p), (1, 1): (5, p), (1, 2): (None, t)}


def packets(spark, data):
    return spark.createDataFrame([("s", s, a, str(s)) for s, a in data], "stream string, sequence long, arrival_ms long, payload string")


def test_playout(spark):
    assert rows(playout.playout(packets(spark, [(0, 1000), (2, 1010), (1, 1015)]), 20, 60, True)) == [("s", 0, "packet", "0"), ("s", 1, "packet", "1"), ("s", 2, "packet", "2")]
    # the first arrival is not the lowest: what is before it is late
    p = packets(spark, [(1, 1000), (0, 1005), (3, 1200), (4, 1001)])
    assert rows(playout.playout(p, 20, 60, False), "sequence", "kind", "payload") == [(1, "packet", "1"), (2, "concealed", "1"), (3, "concealed", "1"), (4, "packet", "4")]
    assert rows(playout.late(p, 20, 60), "sequence") == [(0,), (3,)]
    assert rows(playout.gaps(p), "gap_start", "gap_end", "n_missing") == [(2, 2, 1)]
    sent = packets(spark, [(i, 0) for i in range(5)])
    assert rows(playout.recoverable(sent, sent.filter("sequence NOT IN (0, 2)"), 3), "sequence", "recovered") == [(0, False), (2, True)]


def test_loss_masking(spark):
    rng = random.Random(123)
    data = [(i, 1000 + 20 * i) for i in range(1000) if i in (0, 999) or rng.random() > 0.08]
    out = playout.effective_loss(playout.playout(packets(spark, data), 20, 100, True)).first()
    assert (out["played"], out["concealed"]) == (1000, 1000 - len(data))


def test_stream_playout_is_the_batch_one(spark, tmp_path):
    rng = random.Random(4)
    data = [(k, s, 1000 + 20 * s + rng.randrange(120), f"{k}-{s}") for k in range(5) for s in range(60) if rng.random() > 0.1]
    far = [(99, 0, 10_000_000, "end")]
    df = spark.createDataFrame(data + far, "stream long, sequence long, arrival_ms long, payload string")
    df.withColumn("at", F.timestamp_millis("arrival_ms")).coalesce(1).write.parquet(f"{tmp_path}/p")
    stream = spark.readStream.schema("stream long, sequence long, arrival_ms long, payload string, at timestamp").parquet(f"{tmp_path}/p")
    got = all_available(processors.keyed(stream, "stream", processors.Playout(20, 60), "at"))
    assert rows(got.filter("stream < 99")) == rows(playout.playout(df.filter("stream < 99"), 20, 60, False))


class CountedState:
    """A handle with value and map states in memory and timers; counts what goes to the JVM and back in Spark."""

    def __init__(self):
        self.calls, self.timers = 0, []

    def _state(self, names):
        from types import SimpleNamespace

        held = {}
        do = {
            "exists": lambda: bool(held), "get": lambda: held.get(None), "update": lambda v: held.update({None: v}), "clear": held.clear,
            "containsKey": lambda k: k in held, "getValue": held.get, "updateValue": lambda k, v: held.update({k: v}), "removeKey": lambda k: held.pop(k, None), "iterator": lambda: iter(list(held.items())),
        }
        return SimpleNamespace(held=held, **{n: self._counted(f) for n, f in do.items()})

    def _counted(self, f):
        def call(*args):
            self.calls += 1
            return f(*args)

        return call

    def getValueState(self, name, *_):  # noqa: N802
        return self._state(name)

    getMapState = getValueState  # noqa: N815

    def registerTimer(self, t):  # noqa: N802
        self._counted(self.timers.append)(t)

    def deleteTimer(self, t):  # noqa: N802
        self._counted(self.timers.remove)(t)

    def listTimers(self):  # noqa: N802
        return iter(self._counted(lambda: list(self.timers))())

    def fire(self, processor, key, watermark):
        from types import SimpleNamespace

        out = []
        for t in sorted(t for t in self.timers if t <= watermark):
            out += processor.handleExpiredTimer(key, SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark), SimpleNamespace(getExpiryTimeInMs=lambda t=t: t))
            self.timers.remove(t)
        return [tuple(r) for frame in out for r in frame.itertuples(index=False)]


def test_sessions_take_few_state_calls():
    """A call is a round trip to the JVM; they were several for each session, and each timer read them all."""
    import pandas as pd

    sessions, handle = processors.Sessions(8_000), CountedState()
    sessions.init(handle)
    ms = [10_000 * i for i in range(1000)]
    random.Random(5).shuffle(ms)
    for part in (ms[:600], ms[600:]):
        assert not [r for f in sessions.handleInputRows((7,), iter([pd.DataFrame({"ms": part[:300]}), pd.DataFrame({"ms": part[300:]})]), None) for r in f.itertuples()]
    assert handle.calls <= 8 and handle.timers == [8_000]
    want = [(7, 10_000 * i, 10_000 * i, 1) for i in range(1000)]
    assert handle.fire(sessions, (7,), 4_998_000) == want[:500] and handle.timers == [5_008_000]
    assert handle.fire(sessions, (7,), 4_999_999) == [] and handle.fire(sessions, (7,), 1 << 50) == want[500:]
    assert handle.calls <= 20 and not handle.timers and not sessions.open.held


def test_playout_takes_few_state_calls():
    """They were ten for each packet."""
    import pandas as pd

    played, handle = processors.Playout(20, 60), CountedState()
    played.init(handle)
    data = [(1000 + 20 * s, s, str(s)) for s in range(2000)] + [(1005, s, f"early {s}") for s in range(2000, 2200)]
    got = []
    for part in (data[:1000], data[1000:]):
        got += [tuple(r) for f in played.handleInputRows((3,), iter([pd.DataFrame(part, columns=["arrival_ms", "sequence", "payload"])]), None) for r in f.itertuples(index=False)]
    assert handle.calls < 50 and len(handle.timers) == 1
    got += handle.fire(played, (3,), 1 << 50)
    assert got == [(3, s, "packet", str(s) if s < 2000 else f"early {s}") for s in range(2200)] and handle.calls < 70 and not played.waiting.held


def test_playout_keys_hold_many_streams():
    """A key for each stream costs state calls, a timer and a frame for each. Two streams have the same numbers, as all others."""
    import pandas as pd

    rng = random.Random(8)
    data = [(k, s, 1000 + 20 * s + rng.randrange(120) - (3000 if s > 160 and rng.random() < 0.3 else 0), f"{k}-{s}") for k in range(200) for s in range(rng.randrange(1, 300)) if rng.random() > 0.1]
    frames = [pd.DataFrame([p for p in data if a <= p[2] < b], columns=["stream", "sequence", "arrival_ms", "payload"]) for a, b in ((0, 2500), (2500, 4000), (4000, 1 << 40))]
    told = lambda out: [tuple(r) for f in out for r in f.itertuples(index=False)]

    def played(key, frames):
        processor, handle = processors.Playout(20, 60), CountedState()
        processor.init(handle)
        got = []
        for watermark, frame in zip((2500, 4000, 1 << 50), frames, strict=True):
            if len(frame):
                got.append(sorted(told(processor.handleInputRows(key, iter([frame[::2], frame[1::2]]), None))))
            assert len(handle.timers) <= 1
            got.append(sorted(handle.fire(processor, key, watermark)))
        assert not processor.waiting.held and not handle.timers
        return sorted(r for part in got for r in part), handle.calls

    all_of, calls = played((0,), frames)
    each = [played((k,), [f[f["stream"] == k] for f in frames])[0] for k in range(200)]
    assert all_of == sorted(r for one in each for r in one) and calls < 100


def test_stream_playout_in_buckets_is_the_batch_one(spark, tmp_path):
    rng = random.Random(9)
    data = [(k, s, 1000 + 20 * s + rng.randrange(120), f"{k}-{s}") for k in range(40) for s in range(30) if rng.random() > 0.1]
    df = spark.createDataFrame(data + [(99, 0, 10_000_000, "end")], "stream long, sequence long, arrival_ms long, payload string")
    df.withColumn("at", F.timestamp_millis("arrival_ms")).coalesce(1).write.parquet(f"{tmp_path}/p")
    stream = spark.readStream.schema("stream long, sequence long, arrival_ms long, payload string, at timestamp").parquet(f"{tmp_path}/p")
    got = all_available(processors.keyed(stream, "stream", processors.Playout(20, 60), "at", buckets=4))
    assert rows(got.filter("stream < 99")) == rows(playout.playout(df.filter("stream < 99"), 20, 60, False))


def test_stream_playout_over_batches_is_the_batch_one(spark, tmp_path):
    """Packets wait over several batches, in several blocks."""
    import os

    rng = random.Random(6)
    data = [(k, s, 1000 + 20 * s + rng.randrange(120) - (3000 if s > 160 and rng.random() < 0.3 else 0), f"{k}-{s}") for k in range(3) for s in range(400) if rng.random() > 0.1]
    cuts = [0, 2500, 4000, 5500, 7000, 1 << 40]
    parts = [[p for p in data if a <= p[2] < b] for a, b in zip(cuts, cuts[1:], strict=False)] + [[(99, 0, 10_000_000, "end")]]
    schema = "stream long, sequence long, arrival_ms long, payload string"
    (tmp_path / "in").mkdir()
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).withColumn("at", F.timestamp_millis("arrival_ms")).coalesce(1).write.parquet(f"{tmp_path}/{i}")
        (f,) = (tmp_path / str(i)).glob("*.parquet")
        f.rename(tmp_path / "in" / f"{i}.parquet")
        os.utime(tmp_path / "in" / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema + ", at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = all_available(processors.keyed(stream, "stream", processors.Playout(20, 60), "at"))
    assert rows(got.filter("stream < 99")) == rows(playout.playout(spark.createDataFrame(data, schema), 20, 60, False))


def test_estimators(spark):
    s = spark.createDataFrame([("a", 0, 12500), ("a", 1000, 0)], "k string, ms long, b long")
    assert rows(estimators.sliding_rate(s, "k", "ms", "b", 1000), "ms", "kbps")[1] == (1000, 100.0)
    s = spark.createDataFrame([("a", 0, 100000), ("a", 4000, 1000), ("a", 4500, 0)], "k string, ms long, b long")
    assert rows(estimators.sliding_rate(s, "k", "ms", "b", 500), "ms", "kbps")[2] == (4500, 16.0)
    e = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 0.0), ("a", 3, 1.0)], "k string, n int, x double")
    assert abs(estimators.ema(e, "k", ["n"], F.col("x"), 0.2, "m").first()["m"] - 0.84) < 1e-12
    assert [round(r["m"], 9) for r in estimators.running_ema(e, "k", ["n"], "x", 0.2, "m").orderBy("n").collect()] == [1.0, 0.8, 0.84]


def test_control(spark):
    trace = [2500] * 7 + [300] * 5 + [2500] * 8
    df = spark.createDataFrame([("a", i + 1, float(k), 0.0) for i, k in enumerate(trace)], "k string, s int, kbps double, loss double")
    level = [r["level"] for r in control.rate_ladder(df, "k", ["s"], "kbps", "loss").orderBy("s").collect()]
    assert level == ["low"] * 2 + ["medium"] * 5 + ["low"] * 7 + ["medium"] * 6 or level[2:7] == ["medium"] * 5
    assert control.next_level(0, 9, 0.0, 0.0) == (0, 10)  # an unknown rate is good but carries nothing
    q = spark.createDataFrame([("a", i, 1) for i in range(6)], "k string, i int, size int").withColumn("ms", F.lit(0).cast("long"))
    assert [r["accepted"] for r in control.token_bucket(q, "k", ["i"], "ms", "size", 10.0, 5.0).orderBy("i").collect()] == [True] * 5 + [False]
    d = spark.createDataFrame([("a", 0, 0 if i < 5 else 1, i, 200, 8) for i in range(25)], "k string, t long, p int, i int, size long, kbps int")
    sent = control.priority_drain(d, "k", "t", "p", ["i"], "size", "kbps")
    assert sent.filter("p = 0 AND sent").count() == 5 and sent.filter("p = 1 AND sent").count() == 2


def test_metrics(spark):
    obs = spark.createDataFrame([("m", v) for v in (5.0, 50.0, 500.0, 5000.0, 10.0)], "n string, v double")
    got = {r["bound"]: r["cumulative"] for r in metrics.histogram(obs, "n", "v", (10, 100, 1000)).collect()}
    assert got == {10.0: 1, 100.0: 3, 1000.0: 4, None: 5}
    counted = spark.createDataFrame([("requests_total", 5)], "name string, value long")
    gauges = spark.createDataFrame([("queue_depth", 42)], "name string, value long")
    text = metrics.prometheus(counted, gauges, metrics.histogram(obs, "n", "v", (10, 100)).withColumnRenamed("n", "name")).first()["text"]
    assert text.startswith("# TYPE requests_total counter\nrequests_total 5\n# TYPE queue_depth gauge\nqueue_depth 42\n# TYPE m histogram\n")
    assert 'm_bucket{le="10"} 1\nm_bucket{le="100"} 3\nm_bucket{le="+Inf"} 5\nm_sum 5565\nm_count 5\n' in text
    assert rows(metrics.percentiles(obs, "n", "v", (0, 50, 100)), "percent", "v") == [(0, 5.0), (100, 5000.0), (50, 50.0)]
    spans = spark.createDataFrame([(1, 1, 0, 0, 10), (1, 2, 1, 1, 9), (1, 3, 2, 2, 4), (1, 4, 2, 5, 5)], "trace_id long, span_id long, parent_span_id long, start_ms long, end_ms long")
    assert rows(metrics.span_tree(spans), "span_id", "depth", "duration_ms") == [(1, 0, 10), (2, 1, 8), (3, 2, 2), (4, 2, 0)]


def test_membership(spark):
    beats = spark.createDataFrame([("a", 0), ("b", 5000), ("c", 5001)], "k string, ms long")
    now = spark.createDataFrame([(10_000,)], "now_ms long")
    assert rows(membership.liveness(beats, "k", "ms", now, 5000), "k", "alive") == [("a", False), ("b", False), ("c", True)]
    e = spark.createDataFrame([("a", 0), ("a", 10), ("a", 19)], "k string, ms long")
    assert rows(membership.sessions(e, "k", "ms", 10), "session_start", "n") == [(0, 1), (10, 2)]
    values = spark.range(1, 501)
    assert membership.linearizable(values, "id").first()["linearizable"]
    assert not membership.linearizable(values.union(spark.range(3, 4)), "id").first()["linearizable"]


def test_codecs(spark):
    df = spark.createDataFrame([(42, 840, 1, b"\x01\x02\x03\x04\x05")], "s long, t long, f int, p binary")
    coded = df.select(codecs.encode_media(F.col("s"), F.col("t"), F.col("f"), F.col("p")).alias("m"), codecs.encode_retransmit(F.lit(777)).alias("r"))
    d = coded.select(codecs.decode_packet(F.col("m")).alias("m"), codecs.decode_packet(F.col("r")).alias("r"), codecs.decode_packet(F.expr("substring(m, 1, octet_length(m) - 1)")).alias("c"), codecs.decode_packet(F.expr("cast('' AS binary)")).alias("e")).first()
    assert tuple(d["m"]) == ("media", 42, 840, 1, bytearray(b"\x01\x02\x03\x04\x05"))
    assert (d["r"]["kind"], d["r"]["sequence"]) == ("retransmit", 777)
    assert (d["c"]["kind"], d["c"]["sequence"], d["e"]["kind"]) == ("malformed", None, "malformed")
    stream = b"\x00\x00\x00\x02ab" + b"\x00\x00\x00\x00" + b"\xff\xff\xff\xff rest"
    chunks = spark.createDataFrame([("x", i, stream[i : i + 1]) for i in range(len(stream))] + [("y", 0, b"\x00\x00\x00\x09abc")], "s string, n int, c binary")
    got = codecs.decode_frames(chunks, "s", "n", "c").orderBy("frame").collect()
    assert [(r["frame"], None if r["payload"] is None else bytes(r["payload"]), r["error"]) for r in got] == [(0, b"ab", None), (1, b"", None), (2, None, "frame too large")]
    silence = spark.createDataFrame([([12000] * 160,), ([5] * 160,), ([],), ([199, 200],), ([200, 200],)], "s array<smallint>").select(scalars.is_silent(F.col("s"))).collect()
    assert [r[0] for r in silence] == [False, True, True, True, False]
    pcm = [struct.pack("<160h", *[12000, -12000] * 80), struct.pack("<160h", *[5] * 160) + b"x", b"", b"z", struct.pack("<h", -32768)]
    payload = spark.createDataFrame([(p,) for p in pcm], "p binary").select(scalars.silence_of_payload(F.col("p"))).collect()
    assert [r[0] for r in payload] == [False, True, False, False, False]


def test_config(spark):
    lines = spark.createDataFrame(list(enumerate(["# comment", "", "port=9092", "name = broker-1", "enabled=true", "port=1"])), "line_no int, line string")
    assert rows(with_environment(parse_config(lines), {"name": "env"})) == [("enabled", "true"), ("name", "env"), ("port", "1")]


def test_deep_spans(spark):
    """A chain of 100 spans, one of another trace, and spans that no root reaches."""
    chain = [(1, k, k - 1, 0, k) for k in range(1, 101)] + [(2, 1, 0, 5, 4)]
    lost = [(1, 500, 499, 0, 1), (1, 501, 500, 0, 1), (3, 1, 2, 0, 1), (3, 2, 1, 0, 1)]
    spans = spark.createDataFrame(chain + lost, "trace_id long, span_id long, parent_span_id long, start_ms long, end_ms long")
    got = sorted(map(tuple, metrics.span_tree(spans).select("trace_id", "span_id", "depth", "duration_ms").collect()))
    assert got == [(1, k, k - 1, k) for k in range(1, 101)] + [(2, 1, 0, 0)]
    assert metrics.span_tree(spans.filter("false")).count() == 0


def test_ranges_of_a_key(spark):
    """Ordinals, last, previous and following values over many ranges, with ties in the first order column and null keys."""
    rng = random.Random(2)
    data = [(rng.choice([None, "a", "a", "a", "b'\\"]), rng.choice([None, 1.5, 2.5, -1e300]), i, rng.choice([None, i])) for i in range(700)]
    df = spark.createDataFrame(data, "k string, t double, i int, x int").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        cut = ordering.with_ranges(df, ["t", "i"])
        x = F.col("x")
        got = ordering.carried(cut, ["k"], ["t", "i"], {"n": ("before", F.lit(1).cast("long")), "l": ("last", x), "p": ("previous", x), "f": ("following", x)}).collect()
        assert max(r["_range"] for r in got) > 15
        alone = {r["i"]: r["n"] for r in ordering.dense_ordinals(df, [], ["t", "i"], "n").collect()}
        odd = spark.createDataFrame([(f"it's \\{i}", i) for i in range(50)], "s string, i int")
        assert sorted(r["n"] for r in ordering.dense_ordinals(odd, [], ["s"], "n").collect()) == list(range(50))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    by = lambda r: (r[1] is not None, r[1] or 0.0, r[2])
    assert alone == {r[2]: n for n, r in enumerate(sorted(data, key=by))}
    want = {}
    for k in {r[0] for r in data}:
        mine, last = sorted((r for r in data if r[0] == k), key=by), None
        for n, r in enumerate(mine):
            last = r[3] if r[3] is not None else last
            want[r[2]] = (n, last, mine[n - 1][3] if n else None, mine[n + 1][3] if n + 1 < len(mine) else None)
    assert {r["i"]: (r["n"], r["l"], r["p"], r["f"]) for r in got} == want


def test_poll_stops_at_a_gap(spark):
    log_ = spark.createDataFrame([(0, o) for o in (0, 1, 2, 4, 5)] + [(1, o) for o in range(9)] + [(2, 7)], "partition int, offset long")
    cursors = spark.createDataFrame([(0, 1), (1, 3), (2, 0)], "partition int, cursor long")
    assert rows(groups.poll(log_, cursors, 100), "partition", "offset") == [(0, 1), (0, 2), *((1, o) for o in range(3, 9))]
    assert rows(groups.poll(log_, cursors, 4), "partition", "offset") == [(0, 1), (0, 2), (1, 3), (1, 4)]


def test_a_large_poll_sorts_no_records(spark, monkeypatch):
    """Gaps within, at the edge of and between bitmaps, a partition without gap, one without records at its cursor."""
    import re

    whole = {0: set(range(70_000)) - {33_000}, 1: set(range(65_541)), 2: set(range(5, 70_000)) - set(range(32_773, 65_541)), 3: {9}, 4: set(range(40)) - {25}, 5: {0, 1, 2, 4}}
    cursors = {0: 0, 1: 5, 2: 5, 3: 0, 4: 1, 5: 3}
    log_ = spark.createDataFrame([(p, o) for p, offsets in whole.items() for o in offsets], "partition int, offset long")
    at = spark.createDataFrame(list(cursors.items()), "partition int, cursor long")
    monkeypatch.setattr(groups, "SORTED", 0)
    want = []
    for p, o in cursors.items():
        while o in whole[p]:
            want.append((p, o))
            o += 1
    for limit in (200_000, 40_000, len(want), 33_001, 1):
        got = groups.poll(log_, at, limit)
        assert got.columns == ["partition", "offset"] and sorted(map(tuple, got.collect())) == want[:limit]
    assert not re.search(r"windowspecdefinition\([^)]*offset", got._jdf.queryExecution().executedPlan().toString())


def test_a_jump_of_the_sequence(spark, monkeypatch):
    monkeypatch.setattr(playout, "CHUNK", 64)
    data = [(0, 1000), (1, 1020), (5_000, 101_000), (5_001, 101_021)]
    out = playout.playout(packets(spark, data), 20, 60, True)
    assert out.count() == 5_002 and out.filter("kind = 'packet'").count() == 4
    assert rows(out.filter("sequence IN (1, 2, 4999, 5000)"), "sequence", "payload") == [(1, "1"), (2, "1"), (4999, "1"), (5000, "5000")]


def test_null_samples(spark):
    e = spark.createDataFrame([("a", 1, None), ("a", 2, 1.0), ("a", 3, None), ("a", 4, 0.0), ("b", 1, None), (None, 1, 2.0)], "k string, n int, x double")
    assert rows(estimators.ema(e, "k", ["n"], F.col("x"), 0.5, "m")) == [("a", 0.5), ("b", None), (None, 2.0)]
    assert [r["m"] for r in estimators.running_ema(e.filter("k = 'a'"), "k", ["n"], "x", 0.5, "m").orderBy("n").collect()] == [None, 1.0, 1.0, 0.5]
    s = spark.createDataFrame([("a", 1, None, None), ("a", None, 5, None)], "k string, ms long, size long, kbps int")
    assert control.rate_ladder(s, "k", ["ms"], "kbps", "size").count() == 2
    assert all(r["accepted"] for r in control.token_bucket(s, "k", ["ms"], "ms", "size", 10.0, 5.0).collect())
    d = s.withColumn("p", F.lit(1))
    assert sorted(r["sent"] for r in control.priority_drain(d, "k", "ms", "p", ["size"], "size", "kbps").collect()) == [False, True]
    assert rows(membership.sessions(s, "k", "ms", 10), "session_start", "n") == [(1, 1)]


def test_adaptive_drain(spark):
    """Two bad reports hold the lowest rate; three good ones lift it, and more is sent."""
    q = spark.createDataFrame([("a", t * 1000, 1, i, 4000) for t in range(6) for i in range(20)], "k string, t long, p int, i int, size long")
    r = spark.createDataFrame([("a", t * 1000, 100.0 if t < 2 else 4000.0, 0.0) for t in range(6)], "k string, t long, kbps double, loss double")
    out = control.adaptive_drain(q, r, "k", "t", "p", ["i"], "size", "kbps", "loss")
    sent = {x["t"]: (x["level_kbps"], x["n"]) for x in out.groupBy("t", "level_kbps").agg(F.count_if("sent").alias("n")).collect()}
    assert [sent[t * 1000][0] for t in range(6)] == [128, 128, 128, 128, 512, 512]
    assert sent[0][1] == 2 and sent[5000][1] == 8


def test_recovery_cuts_and_reads_on(spark, tmp_path):
    folder = f"file://{tmp_path}/log"
    segments.register(spark)
    data = spark.range(200).selectExpr("'t' AS topic", "cast(id % 2 AS int) AS partition", "id div 2 AS offset", "cast(repeat('x', cast(id % 40 AS int)) AS binary) AS payload")
    segments.append(data, folder, 600, 100)
    found = [s for s in segments.list_segments(folder) if s.partition == 1]
    middle = found[len(found) // 2]
    blob = bytearray(open(middle.path, "rb").read())
    blob[-1 if blob[-1] else -3] ^= 0xFF
    open(middle.path, "wb").write(bytes(blob))
    with open(found[-1].path, "ab") as f:
        f.write(bytes(100))  # preallocated, never written
    first = {r["segment_base"]: r for r in segments.recover(spark, folder, 100).filter("partition = 1").collect()}
    assert [b for b, r in first.items() if r["torn_bytes"]] and first[middle.base]["torn_bytes"] > 16 and first[found[-1].base]["torn_bytes"] == 100
    assert [r["sealed"] for _, r in sorted(first.items())] == [True] * (len(found) - 1) + [False]
    assert first[found[-1].base]["next_offset"] == 100
    assert not segments.recover(spark, folder, 100).filter("torn_bytes > 0").count()
    lost = {middle.base + first[middle.base]["records"]}
    df = spark.read.format("segments").load(folder).filter("partition = 1")
    assert {r["offset"] for r in df.collect()} == set(range(100)) - lost
    for least in (0, 1, 17, 55, 99, 100):
        got = sorted(r["offset"] for r in df.filter(f"offset >= {least}").collect())
        assert got == sorted(set(range(least, 100)) - lost)


def test_index_is_used_and_streams_restart(spark, tmp_path):
    from logmill.streaming.run import started

    folder = f"file://{tmp_path}/log"
    segments.register(spark)
    data = spark.range(300).selectExpr("'t' AS topic", "0 AS partition", "id AS offset", "cast(repeat('y', 30) AS binary) AS payload")
    segments.append(data.filter("offset < 100"), folder, 1000, 200)
    s = segments.list_segments(folder)[1]
    system, _ = segments.file_system(folder)
    assert segments.indexed_place(system, s, s.base + 19)[0] > s.base and segments.indexed_place(system, s, s.base) == (s.base, 0)
    out = f"file://{tmp_path}/stream"
    stream = lambda: spark.readStream.format("segments").load(folder).select("offset")
    started(stream(), out).awaitTermination()
    segments.append(data.filter("offset >= 100"), folder, 1000, 200)
    started(stream(), out).awaitTermination()
    started(stream(), out).awaitTermination()
    assert sorted(r["offset"] for r in spark.read.parquet(f"{out}/out").collect()) == list(range(300))


def _many_segments(spark, folder):
    """1,000 segments of a record each, in two log partitions."""
    segments.register(spark)
    data = spark.range(1000).selectExpr("'t' AS topic", "cast(id % 2 AS int) AS partition", "id div 2 AS offset", "cast(id AS string) AS payload")
    segments.append(data, folder, 20, 8)
    assert len(segments.list_segments(folder)) == 1000
    return folder


def test_small_segments_share_tasks(spark, tmp_path):
    folder = _many_segments(spark, f"file://{tmp_path}/log")
    assert sorted(f.name for f in (tmp_path / "log/t/partition-1").iterdir())[:2] == [f"{0:020d}.idx", f"{0:020d}.seg"]
    df = spark.read.format("segments").load(folder)
    assert df.rdd.getNumPartitions() <= 2 * segments.TASKS
    assert {(r["partition"], r["offset"], bytes(r["payload"])) for r in df.collect()} == {(i % 2, i // 2, str(i).encode()) for i in range(1000)}
    large = [segments.Segment("t", 0, i, "", segments.TASK_BYTES) for i in range(3)]
    assert [t.held for t in segments.packed(large)] == [[s] for s in large]


def test_replay_of_records_longer_than_a_read(tmp_path):
    import io

    payloads = [b"x" * n for n in (0, 3, 100, 5, 0, 64)]
    blob = b"".join(segments.encode_record(i, p) for i, p in enumerate(payloads, 7))
    for chunk in (1, 7, 16, 50, 1000):
        assert [r[3] for r in segments.replay(io.BytesIO(blob), 7, chunk)] == payloads
        assert [r[3] for r in segments.replay(io.BytesIO(blob[:-1]), 7, chunk)] == payloads[:-1]


def test_recovery_of_small_segments_shares_tasks(spark, tmp_path):
    folder = _many_segments(spark, f"file://{tmp_path}/log")
    torn = segments.list_segments(folder)[300]
    with open(torn.path, "rb+") as f:
        f.truncate(torn.size - 1)
    told = segments.recover(spark, folder, 8)
    assert told.count() == 1000 and len(told.inputFiles()) <= 2 * segments.TASKS
    assert rows(told.filter("torn_bytes > 0"), "partition", "segment_base", "records") == [(torn.partition, torn.base, 0)]


def test_a_stream_of_small_segments_shares_tasks(spark, tmp_path):
    folder = _many_segments(spark, f"file://{tmp_path}/log")
    stream = segments.SegmentStream(folder)
    end = stream.latestOffset()
    assert len(stream.partitions({}, end)) <= 2 * segments.TASKS and not stream.partitions(end, end)[0].held
    assert [s.base for t in stream.partitions({"t/0": 497, "t/1": 499}, end) for s in t.held] == [498, 499]
    got = all_available(spark.readStream.format("segments").load(folder).select("partition", "offset"))
    assert sorted(map(tuple, got.collect())) == [(p, o) for p in range(2) for o in range(500)]


def test_reads_of_small_segments_are_pruned_and_share_tasks(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual

    folder = _many_segments(spark, f"file://{tmp_path}/log")
    reader = segments.SegmentReader(folder)
    list(reader.pushFilters([EqualTo(("partition",), 1), GreaterThanOrEqual(("offset",), 50)]))
    tasks = reader.partitions()
    assert len(tasks) <= 2 * segments.TASKS and [(s.partition, s.base) for t in tasks for s in t.held] == [(1, o) for o in range(50, 500)]
    df = spark.read.format("segments").load(folder).filter("partition = 1 AND offset >= 50")
    assert sorted(r["offset"] for r in df.collect()) == list(range(50, 500))


def test_stream_sink(spark, tmp_path):
    segments.register(spark)
    spark.range(100).selectExpr("'t' AS topic", "0 AS partition", "id AS offset", "cast('z' AS binary) AS payload").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("topic string, partition int, offset long, payload binary").parquet(f"{tmp_path}/in")
    stream.writeStream.format("segments").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"file://{tmp_path}/log").awaitTermination()
    assert spark.read.format("segments").load(f"file://{tmp_path}/log").count() == 100


def test_sessions_of_unordered_batches(spark, tmp_path):
    """Events that come in a later batch, before an open session's start or between two."""
    import os

    batches = [[(1, 5_000), (1, 20_000)], [(1, 4_500), (1, 1_000)], [(1, 12_500), (2, 7_000)], [(9, 1_000_000)], [(9, 2_000_000)]]
    for k, events in enumerate(batches):
        spark.createDataFrame(events, "user_id long, ms long").coalesce(1).write.parquet(f"{tmp_path}/{k}")
        (tmp_path / "in").mkdir(exist_ok=True)
        (f,) = (tmp_path / str(k)).glob("*.parquet")
        f.rename(tmp_path / "in" / f"{k}.parquet")
        os.utime(tmp_path / "in" / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema("user_id long, ms long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withColumn("at", F.timestamp_millis("ms"))
    out = all_available(processors.keyed(stream, "user_id", processors.Sessions(8_000), "at", "60 seconds"))
    assert rows(out.filter("user_id < 9")) == [(1, 1_000, 20_000, 5), (2, 7_000, 7_000, 1)]


def test_late_rows_are_counted(spark, tmp_path):
    from logmill.streaming.run import late_rows

    for k, ms in enumerate([(100_000_000,), (100_000_001,), (1,)]):  # rows count as late by the batch before
        spark.createDataFrame([(m, "a") for m in ms], "ms long, k string").selectExpr("timestamp_millis(ms) AS at", "k").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    import glob

    for k, f in enumerate(sorted(glob.glob(f"{tmp_path}/in/*.parquet"), key=lambda f: __import__("os").path.getmtime(f))):
        __import__("os").utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema("at timestamp, k string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    counted = processors.tumbling_counts(stream, "at", "k", "1 second", "1 second")
    query = counted.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert late_rows(query) == 1


def test_paths_without_scheme(spark):
    """They mean what Spark takes them for, and nothing local is invented on a cluster."""
    from types import SimpleNamespace

    from logmill.sources import storage

    assert storage.qualified(spark, "/tmp/x") == "file:/tmp/x"
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "viewfs://store/")
    conf.set("fs.viewfs.mounttable.store.link./a", "file:///tmp")
    try:
        assert storage.qualified(spark, "/a/b") == "viewfs://store/a/b"
    finally:
        conf.set("fs.defaultFS", before)
    with pytest.raises(ValueError):
        storage.file_system("/tmp/x")
    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="a"))
    with pytest.raises(ValueError, match="share"):
        storage.scratch_root(far)
