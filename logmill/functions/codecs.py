"""Binary layouts as column expressions: frames, media packets, acknowledgement requests.

Fixed values: a frame is a big-endian 32-bit length and its payload, of at most MAX_FRAME bytes; a media packet
is type 0, sequence and time stamp (32 bits), flags (8), length (16) and payload, little-endian; a request for
retransmission is type 1 and a sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_FRAME = 16 << 20
MEDIA, RETRANSMIT, HEADER = 0, 1, 12


def unsigned(value: Column, size: int, little: bool = True) -> Column:
    """``value`` modulo 256^size as ``size`` bytes."""
    digits = F.lpad(F.hex(F.pmod(value.cast("long"), F.lit(256**size))), 2 * size, "0")
    if little:
        digits = F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))))
    return F.unhex(digits)


def read_unsigned(blob: Column, start: int, size: int, little: bool = True) -> Column:
    """The unsigned number in ``size`` bytes from the zero-based ``start`` on."""
    digits = F.hex(F.substring(blob, start + 1, size))
    if little:
        digits = F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))))
    return F.conv(digits, 16, 10).cast("long")


def encode_frame(payload: Column) -> Column:
    return F.concat(unsigned(F.octet_length(payload), 4, little=False), payload)


def encode_media(sequence: Column, timestamp_ms: Column, flags: Column, payload: Column) -> Column:
    return F.concat(F.unhex(F.lit("00")), unsigned(sequence, 4), unsigned(timestamp_ms, 4), unsigned(flags, 1), unsigned(F.octet_length(payload), 2), payload)


def encode_retransmit(sequence: Column) -> Column:
    return F.concat(F.unhex(F.lit("01")), unsigned(sequence, 4))


def decode_packet(blob: Column) -> Column:
    """struct(kind: media | retransmit | malformed, sequence, timestamp_ms, flags, payload); malformed has nulls."""
    size = F.octet_length(blob)
    kind = F.when(size < 1, "malformed").when((read_unsigned(blob, 0, 1) == RETRANSMIT) & (size == 5), "retransmit")
    kind = kind.when((read_unsigned(blob, 0, 1) == MEDIA) & (size >= HEADER) & (read_unsigned(blob, 10, 2) == size - HEADER), "media").otherwise("malformed")
    media = kind == "media"
    return F.struct(
        kind.alias("kind"),
        F.when(kind != "malformed", read_unsigned(blob, 1, 4)).alias("sequence"),
        F.when(media, read_unsigned(blob, 5, 4)).alias("timestamp_ms"),
        F.when(media, read_unsigned(blob, 9, 1).cast("int")).alias("flags"),
        F.when(media, F.substring(blob, HEADER + 1, 1 << 30)).alias("payload"),
    )


def decode_frames(chunks: DataFrame, stream: str, order: str, chunk: str) -> DataFrame:
    """Frames of each stream whose chunks may cut them anywhere: (stream, frame, payload, error). A length beyond
    MAX_FRAME gives one row with an error and ends its stream. The walk goes on from chunk to chunk, so what
    is held is one unfinished frame."""
    names = [stream, "frame", "payload", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rest, number, dead = object(), b"", 0, False
        for batch in batches:
            out: list[tuple] = []
            for key, _, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    now, rest, number, dead = key, b"", 0, False
                rest += part or b""
                at = 0
                while not dead and len(rest) - at >= 4:
                    size = int.from_bytes(rest[at : at + 4], "big")
                    if size > MAX_FRAME:
                        out.append((key, number, None, "frame too large"))
                        dead = True
                    elif len(rest) - at - 4 < size:
                        break
                    else:
                        out.append((key, number, rest[at + 4 : at + 4 + size], None))
                        at += 4 + size
                        number += 1
                rest = b"" if dead else rest[at:]
            kinds = (batch.schema.field(0).type, pa.int64(), pa.binary(), pa.string())
            yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)

    ordered = chunks.select(stream, order, F.col(chunk).cast("binary").alias(chunk)).repartition(stream).sortWithinPartitions(stream, order)
    kind = dict(chunks.dtypes)[stream]
    return ordered.mapInArrow(run, f"{stream} {kind}, frame long, payload binary, error string")
