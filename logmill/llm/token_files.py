"""Token-id files: the ids of all documents as one array, with Elias-Fano coded document boundaries.

A table becomes shard files in ascending id order, cut by ranges of id and text, and again after SHARD_TOKENS, so their
number follows the input and a task holds the boundaries of one shard. A shard holds its documents' ids one after another
(2 or 4 bytes each), and two Elias-Fano sequences: the documents' ends within the shard and their ids. Both take about
2 + log2(universe / n) bits an entry; a sample of every 64th one bit makes select() a short scan, so a
document's place is found without a table of 64-bit offsets.

Shards are written under another name and then moved, so a task that is run again leaves nothing half
written; the manifest lists only shards whose task succeeded.

Layout of a shard, little-endian: ids | boundaries | doc ids | footer (MAGIC, item size, n docs, n tokens,
lengths of the two coded parts, number of leading null ids).

Defined results: null text is empty (the end id alone); null ids come first; equal ids are ordered by text
and keep one entry per row (many rows of one id spread over tasks by the first 64 characters); an empty table gives no shards; further columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import file_system, qualified, scratch_folder
from .common import slices, text_partitions, written
from .tokens import blocks, encoder_of, read_spec

MAGIC = b"LMTOKEN1"
FOOTER = "<8sQQQQQQ"
SAMPLE = 64
#: Ids after which a shard is closed, at the next document.
SHARD_TOKENS = 1 << 27
ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class EliasFano:
    """A non-decreasing sequence of integers from 0 on."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint64))
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        top = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(top[-1]) + 1, np.uint8)
        high[top] = 1
        planes = [((values >> np.uint64(b)) & np.uint64(1)).astype(np.uint8) for b in range(low_bits)]
        low = np.packbits(np.stack(planes, axis=1).reshape(-1), bitorder="little") if planes else np.zeros(0, np.uint8)
        return cls(n, low_bits, low, np.packbits(high, bitorder="little"), top[::SAMPLE].astype(np.uint64))

    def _low(self, first: int, last: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(last - first, np.int64)
        a, b = first * self.low_bits, last * self.low_bits
        bits = np.unpackbits(self.low[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 : a % 8 + b - a]
        return bits.reshape(-1, self.low_bits).astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))

    def _position(self, i: int) -> int:
        """Where the i-th one bit stands: from the sample before it on, whole bytes by their number of ones."""
        at = int(self.samples[i // SAMPLE])
        skip = i % SAMPLE
        byte = at // 8
        skip += int(ONES[int(self.high[byte]) & ((1 << (at % 8)) - 1)])
        while (k := int(ONES[self.high[byte]])) <= skip:
            skip -= k
            byte += 1
        bits = int(self.high[byte])
        for bit in range(8):
            if bits >> bit & 1:
                if not skip:
                    return 8 * byte + bit
                skip -= 1
        raise AssertionError

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return (self._position(i) - i) << self.low_bits | int(self._low(i, i + 1)[0])

    def select_range(self, first: int, last: int) -> np.ndarray:
        """The values from the first-th on, before the last-th."""
        if first >= last:
            return np.zeros(0, np.int64)
        a, b = self._position(first), self._position(last - 1)
        ones = np.flatnonzero(np.unpackbits(self.high[a // 8 : b // 8 + 1], bitorder="little")) + a // 8 * 8
        ones = ones[(ones >= a) & (ones <= b)]
        return (ones - np.arange(first, last)) << self.low_bits | self._low(first, last)

    def to_bytes(self) -> bytes:
        return struct.pack("<QQQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)) + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> EliasFano:
        n, low_bits, n_low, n_high, n_samples = struct.unpack_from("<QQQQQ", blob)
        at = 40
        low = np.frombuffer(blob, np.uint8, n_low, at)
        high = np.frombuffer(blob, np.uint8, n_high, at + n_low)
        return cls(n, low_bits, low, high, np.frombuffer(blob, "<u8", n_samples, at + n_low + n_high))


class ShardWriter:
    def __init__(self, out, item: int):
        self.out, self.item, self.ends, self.ids, self.total, self.nulls = out, item, array("Q"), array("q"), 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.out.write(ids)
        self.total += len(ids) // self.item
        self.ends.append(self.total)
        if doc_id is None:
            self.nulls += 1
        else:
            self.ids.append(doc_id)

    def close(self) -> None:
        ends = EliasFano.encode(np.frombuffer(self.ends, np.uint64)).to_bytes()
        ids = np.frombuffer(self.ids, np.int64)
        first = int(ids[0]) if len(ids) else 0
        coded = struct.pack("<q", first) + EliasFano.encode((ids - first).view(np.uint64)).to_bytes()
        self.out.write(ends)
        self.out.write(coded)
        self.out.write(struct.pack(FOOTER, MAGIC, self.item, len(self.ends), self.total, len(ends), len(coded), self.nulls))
        self.out.close()


class ShardReader:
    """Random access to a shard: document(i) is its id and its token ids."""

    def __init__(self, file):
        self.file = file
        file.seek(file.size() - struct.calcsize(FOOTER))
        magic, self.item, self.n, self.total, n_ends, n_ids, self.nulls = struct.unpack(FOOTER, file.read(struct.calcsize(FOOTER)))
        if magic != MAGIC:
            raise ValueError("not a token file")
        file.seek(self.total * self.item)
        self.ends = EliasFano.from_bytes(file.read(n_ends))
        coded = file.read(n_ids)
        (self.first,) = struct.unpack_from("<q", coded)
        self.ids = EliasFano.from_bytes(coded[8:])

    def span(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.first + self.ids.select(i - self.nulls)

    def tokens(self, first: int, last: int) -> np.ndarray:
        self.file.seek(first * self.item)
        return np.frombuffer(self.file.read((last - first) * self.item), f"<u{self.item}")

    def document(self, i: int) -> tuple[int | None, np.ndarray]:
        return self.doc_id(i), self.tokens(*self.span(i))

    def __iter__(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc id, start, token ids) of each document, about a million ids read at a time."""
        step = max(1, min(4096, (self.n << 20) // max(1, self.total)))
        for a in range(0, self.n, step):
            b = min(self.n, a + step)
            ends = [self.ends.select(a - 1) if a else 0, *self.ends.select_range(a, b).tolist()]
            ids = [None] * max(0, min(b, self.nulls) - a) + (self.first + self.ids.select_range(max(a, self.nulls) - self.nulls, max(b, self.nulls) - self.nulls)).tolist()
            held = self.tokens(ends[0], ends[-1])
            for k in range(b - a):
                yield ids[k], ends[k], held[ends[k] - ends[0] : ends[k + 1] - ends[0]]


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes the shards and returns the manifest: path, n_docs, n_tokens, start (tokens of all shards before). The
    manifest, a row a shard, is the only thing that comes to the driver. A shard's name tells its place: the task's number,
    then its own within the task; of a task that ran twice the manifest has the files of one run."""
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(read_spec(tokenizer))
    folder = qualified(spark, folder)
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(spec.value)
        end = np.array([end_id], encoder.dtype).tobytes()
        fs, path = file_system(folder)
        task, own, made = TaskContext.get().partitionId(), uuid.uuid4().hex, []
        writer = None

        def close() -> None:
            nonlocal writer
            writer.close()
            name = f"shard-{task:07d}-{len(made):05d}-{own}.tok"
            fs.move(f"{path}/_{own}", f"{path}/{name}")
            made.append((name, len(writer.ends), writer.total))
            writer = None

        for batch in slices(batches):
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in blocks(texts):
                for doc_id, found in zip(ids[a:b], encoder.encode(texts[a:b]), strict=True):
                    if writer is None:
                        writer = ShardWriter(fs.open_output_stream(f"{path}/_{own}"), encoder.dtype.itemsize)
                    writer.add(doc_id, found + end)
                    if writer.total >= shard_tokens:
                        close()
        if writer is not None:
            close()
        yield pa.record_batch([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["name", "n_docs", "n_tokens"])

    ordered = texts.repartitionByRange(partitions or text_partitions(texts), "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    done = written(ordered.mapInArrow(run, "name string, n_docs long, n_tokens long"), "manifest")
    start, out = 0, []
    for r in sorted(done.collect()):
        out.append((f"{folder}/{r['name']}", r["n_docs"], r["n_tokens"], start))
        start += r["n_tokens"]
    return spark.createDataFrame(out, "path string, n_docs long, n_tokens long, start long")


def read_token_files(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document of the shards: its id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, path = file_system(uri)
                with fs.open_input_file(path) as file:
                    cols: list[list] = [[], [], [], []]
                    for doc_id, at, ids in ShardReader(file):
                        for col, v in zip(cols, (doc_id, start + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                            col.append(v)
                        if len(cols[0]) >= 8192:
                            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=[id_col, "start", "n_tokens", "ids_crc32"])
                            cols = [[], [], [], []]
                    if cols[0]:
                        yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=[id_col, "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.count())
    return manifest.select("path", "start").repartition(n).mapInArrow(run, f"{id_col} long, start long, n_tokens long, ids_crc32 long")


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes the token files of ``docs`` to the shared folder and reads them back."""
    return read_token_files(write_token_files(docs, tokenizer, scratch_folder(spark, "tokens"), end_id))
