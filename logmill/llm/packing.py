"""Hierarchical multi-length packing of tokenised documents.

Each document is its token ids and an end id. Whole windows of the longest tier are cut off long documents;
what is left is routed to the smallest tier that holds it. Tiers are packed from the longest down: a piece
opens a sequence, its gap takes the longest whole pieces of shorter tiers that fit, and a last gap is closed
by cutting one short piece. Sequences are thus full at their tier's length (a power of two, so unpadded);
only the last one of a task can be padded. Packing needs no shuffle: a task packs the documents of its input
split, and a lost executor costs a task. Pieces are written to the shared folder; then the sequences of a tier are
numbered over all tasks (a row a task and tier is what that takes) and cut into step groups, of which only the last one of
a tier can have fewer sequences.

Defined results: null text counts as empty (one piece, the end id); a null id stays null; repeated rows are
packed each on their own; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, written
from .tokens import blocks, encoder_of, read_spec

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, nth long"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
TIERS = (128, 256, 512, 1024)
STEP_TOKENS = 1 << 16


class Packer:
    """Takes documents as (key, length); yields sequences as (tier, [(key, start, length)])."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        if any(t & (t - 1) for t in tiers) or sorted(set(tiers)) != list(tiers):
            raise ValueError("tiers are rising powers of two")
        self.tiers = tiers
        #: Pieces (length, key, start) by tier, the shortest first.
        self.pool: list[list[tuple[int, int, int]]] = [[] for _ in tiers]

    def _route(self, length: int) -> int:
        return next(i for i, t in enumerate(self.tiers) if length <= t)

    def _put(self, piece: tuple[int, int, int]) -> None:
        insort(self.pool[self._route(piece[0])], piece)

    def add(self, docs: list[tuple[int, int]]) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        top = self.tiers[-1]
        for key, length in docs:
            whole = length - length % top
            for start in range(0, whole, top):
                yield top, [(key, start, top)]
            if whole < length:
                self._put((length - whole, key, whole))
        yield from self._pack()

    def _fit(self, gap: int, upto: int) -> tuple[int, int, int] | None:
        """The longest whole piece of the tiers up to ``upto`` that fits; else None."""
        for tier in range(min(upto, self._route(gap)), -1, -1):
            at = bisect_right(self.pool[tier], (gap, float("inf"), 0)) - 1
            if at >= 0:
                return self.pool[tier].pop(at)
        return None

    def _pack(self) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        for tier in range(len(self.tiers) - 1, -1, -1):
            size, pool = self.tiers[tier], self.pool[tier]
            while pool:
                piece = pool.pop()
                held, gap = [piece], size - piece[0]
                while gap:
                    short = self._fit(gap, tier)
                    if short is None:  # all pieces left are longer than the gap: one of them is cut
                        donor = next((p for p in self.pool[: tier + 1] if p), None)
                        if donor is None:
                            break
                        length, key, start = donor.pop()
                        self._put((length - gap, key, start + gap))
                        short = (gap, key, start)
                    held.append(short)
                    gap -= short[0]
                if gap:  # not enough documents yet: wait for more
                    self.pool = [[] for _ in self.tiers]
                    for p in held:
                        self._put(p)
                    return
                yield size, [(key, start, length) for length, key, start in held]

    def finish(self) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """What is left is cut at the tiers' lengths; less than the shortest tier makes the one padded sequence."""
        rest = [p for pool in reversed(self.pool) for p in reversed(pool)]
        self.pool = [[] for _ in self.tiers]
        total = sum(p[0] for p in rest)
        while total:
            size = next((t for t in reversed(self.tiers) if t <= total), total)
            held, gap = [], size
            while gap:
                length, key, start = rest.pop(0)
                take = min(gap, length)
                held.append((key, start, take))
                gap -= take
                if take < length:
                    rest.insert(0, (length - take, key, start + take))
            total -= size
            yield size if size in self.tiers else self.tiers[-1], held


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, end_id: int = 0, step_tokens: int = STEP_TOKENS, block_chars: int = 2_000_000) -> DataFrame:
    """One row per piece (SCHEMA). tier: the context size that the sequence is for; step_group: sequences of one
    tier that share a training step, each group with ``step_tokens`` token places, so that steps cost alike."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        encoder, packer = encoder_of(spec.value), Packer(tiers)
        live: dict[int, list] = {}  # key: doc_id, ids as 32-bit bytes, tokens not yet in a sequence
        made: dict[int, int] = dict.fromkeys(tiers, 0)
        n_keys = n_sequences = 0

        def rows(sequences) -> pa.RecordBatch | None:
            nonlocal n_sequences
            cols: list[list] = [[] for _ in range(9)]
            for tier, pieces in sequences:
                offset = 0
                for key, start, length in pieces:
                    doc = live[key]
                    crc = zlib.crc32(memoryview(doc[1])[4 * start : 4 * (start + length)])
                    for col, value in zip(cols, (doc[0], start, length, crc, len(doc[1]) // 4, (task << 40) | n_sequences, offset, tier, made[tier]), strict=True):
                        col.append(value)
                    offset += length
                    doc[2] -= length
                    if not doc[2]:
                        del live[key]
                n_sequences += 1
                made[tier] += 1
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            names = [x.split()[0] for x in PIECES.split(", ")]
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names) if cols[0] else None

        for batch in slices(batches):
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in blocks(texts, block_chars):
                new = []
                for doc_id, found in zip(ids[a:b], encoder.encode(texts[a:b]), strict=True):
                    wide = np.append(np.frombuffer(found, encoder.dtype).astype("<u4"), np.uint32(end_id)).astype("<u4").tobytes()
                    live[n_keys] = [doc_id, wide, len(wide) // 4]
                    new.append((n_keys, len(wide) // 4))
                    n_keys += 1
                if (out := rows(packer.add(new))) is not None:
                    yield out
        if (out := rows(packer.finish())) is not None:
            yield out

    pieces = written(docs.select(id_col, text_col).mapInArrow(run, PIECES), "pieces")
    return _grouped(pieces, tiers, step_tokens).withColumnRenamed("doc_id", id_col)


def _grouped(pieces: DataFrame, tiers: tuple[int, ...], step_tokens: int) -> DataFrame:
    """nth, a sequence's number among those of its tier and task, becomes step_group."""
    task = F.shiftright("sequence_id", 40)
    counts = pieces.groupBy(task.alias("_task"), F.col("tier").alias("_tier")).agg((F.max("nth") + 1).alias("_n"))
    before = Window.partitionBy("_tier").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_task", "_tier", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    order = F.array_position(F.array(*map(F.lit, tiers)), F.col("tier")).cast("long") - 1
    per_group = F.greatest(F.lit(1), F.floor(F.lit(step_tokens) / F.col("tier")))
    group = F.shiftleft(F.floor((F.col("_base") + F.col("nth")) / per_group), 8) + order
    joined = pieces.join(base, (task == F.col("_task")) & (F.col("tier") == F.col("_tier")))
    return joined.select(*(x.split()[0] for x in SCHEMA.split(", ")[:-1]), group.alias("step_group"))
