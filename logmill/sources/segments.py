"""Segment files as a Spark source and sink, batch and streaming.

Fixed values: a record is offset (64 bits), payload length and CRC-32 (32 bits each), little-endian, and the payload;
a segment is named by its first offset in 20 digits; a log lies in <folder>/<topic>/partition-<n>/.

Beside each segment lies its sparse index (.idx): offset and position, 64 bits each, of the first record and of one
after every so many bytes. Reading checks every record and ends a segment at the first one that is empty, out of order,
cut off or damaged; a read from an offset on begins at the index entry before it, so damage before that isn't met.
recover() cuts segments to their valid records, and then both ways agree.

Segments that follow each other make an input partition, in streams too, by their bytes (packed()): small segments are many,
and a task for each would cost more than reading it. Filters on topic, partition and offset prune whole segments before any
is opened. Files are reached with pyarrow, so the folder may be in any shared storage that it knows; it needs its
scheme (storage.qualified() gives it the one that Spark would).
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from .storage import file_system, qualified, scratch_folder

HEADER, ENTRY = "<QII", "<QQ"
HEADER_BYTES, SEGMENT_BYTES, INDEX_BYTES = 16, 64 << 20, 4096
#: Bytes that one task reads, what opening a segment counts as, and tasks that a small log is spread over.
TASK_BYTES, OPEN_BYTES, TASKS = 64 << 20, 64 << 10, 32
#: Rows and payload bytes of a batch that is read, and bytes that a segment being written holds back.
BATCH_ROWS, BATCH_BYTES, HELD_BYTES = 1 << 14, 4 << 20, 1 << 20
SCHEMA = "topic string, partition int, offset long, len long, crc long, payload binary"
RECOVERED = "topic string, partition int, segment_base long, records long, bytes long, torn_bytes long, sealed boolean, next_offset long"


def encode_record(offset: int, payload: bytes) -> bytes:
    return struct.pack(HEADER, offset, len(payload), zlib.crc32(payload)) + payload


def replay(file, base: int, chunk: int = 1 << 22) -> Iterator[tuple[int, int, int, bytes]]:
    """(offset, len, crc, payload) of the valid records of an open segment, from its first offset on."""
    held, at, expected = b"", 0, base
    while True:
        if len(held) - at < HEADER_BYTES:
            held, at = held[at:] + file.read(max(chunk, HEADER_BYTES)), 0
            if len(held) < HEADER_BYTES:
                return
        offset, size, crc = struct.unpack_from(HEADER, held, at)
        if offset != expected or (offset, size, crc) == (0, 0, 0):
            return
        end = at + HEADER_BYTES + size
        if len(held) < end:
            parts, at, end = [held[at:]], 0, HEADER_BYTES + size
            missing = end - len(parts[0])
            while missing > 0:
                more = file.read(max(chunk, missing))
                if not more:
                    return
                parts.append(more)
                missing -= len(more)
            held = b"".join(parts)
        payload = held[at + HEADER_BYTES : end]
        if zlib.crc32(payload) != crc:
            return
        yield offset, size, crc, payload
        at, expected = end, expected + 1


@dataclass
class Segment:
    topic: str
    partition: int
    base: int
    path: str
    size: int = 0


@dataclass
class Segments(InputPartition):
    """Segments that one task reads, in order."""

    held: list[Segment] = field(default_factory=list)

    @property
    def base(self) -> int:
        return self.held[0].base


def packed(found: list[Segment]) -> list[Segments]:
    """Segments in their order, dealt to tasks by bytes and files: as many tasks as the log's size asks for, however small its
    segments are. A task takes TASK_BYTES, or one segment that is larger; less where that would make under TASKS tasks."""
    total = sum(s.size + OPEN_BYTES for s in found)
    each = min(TASK_BYTES, total // TASKS)
    dealt, room = [], 0
    for s in found:
        if not dealt or room < s.size + OPEN_BYTES:
            dealt.append(Segments())
            room = each
        dealt[-1].held.append(s)
        room -= s.size + OPEN_BYTES
    return dealt


def list_segments(folder: str) -> list[Segment]:
    from pyarrow import fs

    system, root = file_system(folder)
    found = []
    for info in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        m = re.search(r"([^/]+)/partition-(\d+)/(\d{20})\.seg$", info.path)
        if m and info.size:
            found.append(Segment(m[1], int(m[2]), int(m[3]), info.path, info.size))
    return sorted(found, key=lambda s: (s.topic, s.partition, s.base))


class SegmentReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.topic, self.partition, self.least, self.most = folder, None, None, 0, None

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0]
            if isinstance(f, EqualTo) and name in ("topic", "partition"):
                setattr(self, name, f.value)
            elif name == "offset" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.least = max(self.least, f.value)
            if name == "offset" and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.most = f.value if self.most is None else min(self.most, f.value)
            yield f  # segments are pruned; Spark still filters the rows

    def partitions(self):
        found = [s for s in list_segments(self.folder) if self.topic in (None, s.topic) and self.partition in (None, s.partition)]
        kept = []
        for s, after in zip(found, [*found[1:], None], strict=False):
            ends = after.base if after is not None and (after.topic, after.partition) == (s.topic, s.partition) else None
            if (self.most is None or s.base <= self.most) and (ends is None or ends > self.least):
                kept.append(s)
        return packed(kept) or [Segments()]

    def read(self, partition: Segments):
        system, _ = file_system(self.folder)
        rows, size = [], 0
        for segment in partition.held:
            offset, position = indexed_place(system, segment, self.least)
            with system.open_input_file(segment.path) as file:
                file.seek(position)
                for record in replay(file, offset):
                    rows.append((segment.topic, segment.partition, *record))
                    size += record[1]
                    if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
        if rows:
            yield batch_of(rows)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), *[pa.int64()] * 3, pa.binary())
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])


def indexed_place(system, segment: Segment, least: int) -> tuple[int, int]:
    """Offset and position of the last index entry at or before ``least``; of the first record without an index."""
    path = segment.path.removesuffix(".seg") + ".idx"
    if least <= segment.base or not system.get_file_info(path).is_file:
        return segment.base, 0
    with system.open_input_stream(path) as file:
        blob = file.read()
    entries = list(struct.iter_unpack(ENTRY, blob[: len(blob) // 16 * 16]))
    at = bisect_right(entries, (least, 1 << 63)) - 1
    return entries[at] if at >= 0 else (segment.base, 0)


class SegmentStream(DataSourceStreamReader):
    """Whole segments as they appear. A position is the first offset of the last segment of each
    partition that was read; a log only grows at its end."""

    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {f"{s.topic}/{s.partition}": s.base for s in list_segments(self.folder)}  # in rising order

    def partitions(self, start: dict, end: dict):
        name = lambda s: f"{s.topic}/{s.partition}"
        return packed([s for s in list_segments(self.folder) if start.get(name(s), -1) < s.base <= end.get(name(s), -1)]) or [Segments()]

    def read(self, partition):
        return SegmentReader(self.folder).read(partition)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    #: (folder, prefix of the temporary names, first offsets) of the segments of a task in each log partition.
    made: list[tuple[str, str, array]] = field(default_factory=list)


def names_of(folder: str, prefix: str, base: int) -> list[tuple[str, str]]:
    """(temporary path, path) of a segment's files, the index before the segment."""
    return [(f"{folder}/{prefix}{base:020d}{end}", f"{folder}/{base:020d}{end}") for end in (".idx", ".seg")]


class SegmentFile:
    """A segment and its index that are being written under other names."""

    def __init__(self, system, folder: str, prefix: str, base: int, index_bytes: int):
        self.system, self.index_bytes, self.entries, self.blocks = system, index_bytes, [], []
        self.records = self.size = self.held = 0
        self.since = index_bytes
        self.index, self.segment = (temporary for temporary, _ in names_of(folder, prefix, base))
        self.out = system.open_output_stream(self.segment)

    def add(self, offset: int, payload: bytes) -> None:
        record = encode_record(offset, payload)
        if self.since >= self.index_bytes or self.since + len(record) >= self.index_bytes:
            self.entries.append((offset, self.size))
            self.since = 0
        else:
            self.since += len(record)
        self.blocks.append(record)
        self.records, self.size, self.held = self.records + 1, self.size + len(record), self.held + len(record)
        if self.held >= HELD_BYTES:
            self._flush()

    def _flush(self) -> None:
        self.out.write(b"".join(self.blocks))
        self.blocks, self.held = [], 0

    def close(self) -> None:
        self._flush()
        self.out.close()
        with self.system.open_output_stream(self.index) as file:
            file.write(b"".join(struct.pack(ENTRY, *e) for e in self.entries))


def _moved(folder: str, messages) -> None:
    """Log partitions side by side, the segments of one in order: who reads meanwhile sees a log that grows at its end."""
    system, _ = file_system(folder)
    logs: dict[str, list[tuple[int, str]]] = {}
    for message in messages:
        for where, prefix, bases in message.made if message is not None else ():
            logs.setdefault(where, []).extend((base, prefix) for base in bases)

    def move(where: str) -> None:
        for base, prefix in sorted(set(logs[where])):
            for temporary, path in names_of(where, prefix, base):
                system.move(temporary, path)

    with ThreadPoolExecutor(16) as pool:
        list(pool.map(move, logs))


class SegmentWriter(DataSourceArrowWriter):
    """Takes rows in order of topic, partition and offset (see arranged()) and writes them as segments; where rows have no
    segment_base, a segment is closed before a record that would pass segment_bytes. Nothing is seen before all
    tasks are done: then files are moved into place."""

    def __init__(self, folder: str, names: list[str], segment_bytes: int, index_bytes: int):
        self.folder, self.names, self.segment_bytes, self.index_bytes = folder, names, segment_bytes, index_bytes

    def write(self, iterator):
        system, root = file_system(self.folder)
        at = {n: i for i, n in enumerate(self.names)}
        made, prefix, now, file = Written(), f"_{uuid.uuid4().hex}-", None, None
        for batch in iterator:
            columns = [batch.column(at[n]).to_pylist() for n in ("topic", "partition", "offset", "payload")]
            bases = batch.column(at["segment_base"]).to_pylist() if "segment_base" in at else [None] * batch.num_rows
            for topic, partition, offset, payload, base in zip(*columns, bases, strict=True):
                payload = payload or b""
                if HEADER_BYTES + len(payload) > self.segment_bytes:
                    raise ValueError(f"record too large: {HEADER_BYTES + len(payload)} bytes in segments of {self.segment_bytes}")
                full = file is not None and file.size + HEADER_BYTES + len(payload) > self.segment_bytes
                if file is None or (topic, partition, base) != now or (base is None and full):
                    if file is not None:
                        file.close()
                    if now is None or (topic, partition) != now[:2]:
                        folder = f"{root}/{topic}/partition-{partition}"
                        system.create_dir(folder, recursive=True)
                        made.made.append((folder, prefix, array("q")))
                    now = (topic, partition, base)
                    made.made[-1][2].append(offset if base is None else base)
                    file = SegmentFile(system, folder, prefix, made.made[-1][2][-1], self.index_bytes)
                file.add(offset, payload)
        if file is not None:
            file.close()
        return made

    def commit(self, messages):
        _moved(self.folder, messages)

    def abort(self, messages):
        system, _ = file_system(self.folder)
        for message in messages:
            for folder, prefix, bases in message.made if message is not None else ():
                for temporary, _ in (pair for base in bases for pair in names_of(folder, prefix, base)):
                    if system.get_file_info(temporary).is_file:
                        system.delete_file(temporary)


class SegmentStreamWriter(DataSourceStreamArrowWriter):
    """The same for streams: a batch that runs again writes the same segments over."""

    def __init__(self, inner: SegmentWriter):
        self.inner = inner

    def write(self, iterator):
        return self.inner.write(iterator)

    def commit(self, messages, batchId):
        self.inner.commit(messages)

    def abort(self, messages, batchId):
        self.inner.abort(messages)


class SegmentSource(DataSource):
    """spark.read.format("segments").load(folder)"""

    @classmethod
    def name(cls):
        return "segments"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return SegmentReader(self.options["path"])

    def streamReader(self, schema):
        return SegmentStream(self.options["path"])

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("segments are only appended")
        return SegmentWriter(self.options["path"], schema.names, int(self.options.get("segmentBytes", SEGMENT_BYTES)), int(self.options.get("indexBytes", INDEX_BYTES)))

    def streamWriter(self, schema, overwrite):
        return SegmentStreamWriter(self.writer(schema, False))


def register(spark: SparkSession) -> None:
    """Makes the format known, and lets filters reach Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SegmentSource)


def rolled(records: DataFrame, segment_bytes: int) -> DataFrame:
    """Adds segment_base to (topic, partition, offset, payload), where the sink would cut. Only this walks a log partition in
    one task, a step a segment; after it each segment can be written by any task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, base, at = None, 0, 0
        for batch in batches:
            n = batch.num_rows
            topics, parts, offsets, payloads = batch.columns
            whole = HEADER_BYTES + pc.fill_null(pc.binary_length(payloads), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            if n and whole.max() > segment_bytes:
                raise ValueError(f"record too large: {whole.max()} bytes in segments of {segment_bytes}")
            ends, numbers, bases = np.cumsum(whole), offsets.to_numpy(zero_copy_only=False), np.zeros(n, np.int64)
            codes = topics.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False), parts.fill_null(-1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((codes[0][1:] != codes[0][:-1]) | (codes[1][1:] != codes[1][:-1])) + 1
            for i, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), n], strict=True) if n else ():
                log = topics[i].as_py(), parts[i].as_py()
                if log != now:
                    now, base, at = log, int(numbers[i]), 0
                while i < stop:
                    done = int(ends[i - 1]) if i else 0
                    fit = min(stop, int(np.searchsorted(ends, done + segment_bytes - at, side="right")))
                    if fit == i:  # full: the next segment starts here
                        base, at = int(numbers[i]), 0
                        continue
                    bases[i:fit] = base
                    at += int(ends[fit - 1]) - done
                    i = fit
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bases)], names=[*batch.schema.names, "segment_base"])

    rows = _typed(records, "topic", "partition", "offset", "payload").repartition("topic", "partition").sortWithinPartitions("topic", "partition", "offset")
    return rows.mapInArrow(run, "topic string, partition int, offset long, payload binary, segment_base long")


def _typed(records: DataFrame, *columns: str) -> DataFrame:
    kinds = {"topic": "string", "partition": "int", "segment_base": "long", "offset": "long", "payload": "binary"}
    return records.select(*(F.col(c).cast(kinds[c]).alias(c) for c in columns))


def arranged(records: DataFrame, segment_bytes: int) -> DataFrame:
    """(topic, partition, offset, payload, maybe segment_base) in the order that the sink takes them: a segment is one task's,
    and a log partition's segments are spread over many."""
    if "segment_base" not in records.columns:
        records = rolled(records, segment_bytes)
    of = ["topic", "partition", "segment_base"]
    return _typed(records, *of, "offset", "payload").repartition(*of).sortWithinPartitions(*of, "offset")


def append(records: DataFrame, folder: str, segment_bytes: int = SEGMENT_BYTES, index_bytes: int = INDEX_BYTES) -> str:
    """Appends records to the log in ``folder``; returns the folder as it can be read."""
    folder = qualified(records.sparkSession, folder)
    arranged(records, segment_bytes).write.format("segments").option("segmentBytes", segment_bytes).option("indexBytes", index_bytes).mode("append").save(folder)
    return folder


def write_segments(laid: DataFrame, folder: str, topic: str, payload: str = "payload", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """Appends records whose segments are known, laid: (partition, offset, segment_base, payload), to a topic's log; returns
    (partition, segment_base, records, bytes)."""
    register(laid.sparkSession)
    rows = laid.withColumns({"topic": F.lit(topic), "payload": F.col(payload).cast("binary")})
    append(rows, folder, (1 << 63) - 1, index_bytes)
    return rows.groupBy("partition", "segment_base").agg(F.count("*").alias("records"), F.sum(F.coalesce(F.octet_length("payload"), F.lit(0)) + HEADER_BYTES).alias("bytes"))


def recover(spark: SparkSession, folder: str, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """Cuts every segment, at once, to its valid records and writes its index anew where any were lost. One row (RECOVERED) a segment:
    all but the last of a log partition are sealed, and the last tells the partition's next offset. Tasks take segments
    as in reading; a task that runs again finds nothing more to cut."""
    folder = qualified(spark, folder)
    found = list_segments(folder)
    last = {(s.topic, s.partition): s.base for s in found}
    rows = [([(s.topic, s.partition, s.base, s.path, s.base < last[s.topic, s.partition]) for s in task.held],) for task in packed(found)]
    listed = spark.createDataFrame(rows, "segments array<struct<topic: string, partition: int, base: long, path: string, sealed: boolean>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(folder)
        for batch in batches:
            out = []
            for topic, partition, base, path, sealed in (tuple(s.values()) for task in batch.column(0).to_pylist() for s in task):
                size, before = 0, system.get_file_info(path).size
                records = 0
                with system.open_input_file(path) as file:
                    for _, n, _, _ in replay(file, base):
                        records, size = records + 1, size + HEADER_BYTES + n
                if size < before:
                    where, prefix = path.rsplit("/", 1)[0], f"_{uuid.uuid4().hex}-"
                    cut = SegmentFile(system, where, prefix, base, index_bytes)
                    with system.open_input_file(path) as file:
                        for offset, _, _, payload in replay(file, base):
                            cut.add(offset, payload)
                    cut.close()
                    for temporary, name in names_of(where, prefix, base):
                        system.move(temporary, name)
                out.append((topic, partition, base, records, size, before - size, sealed, base + records))
            kinds = (pa.string(), pa.int32(), *[pa.int64()] * 4, pa.bool_(), pa.int64())
            yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in RECOVERED.split(", ")])

    told = scratch_folder(spark, "recovered")
    listed.repartition(max(1, len(rows))).mapInArrow(run, RECOVERED).write.parquet(told)
    return spark.read.schema(RECOVERED).parquet(told)
