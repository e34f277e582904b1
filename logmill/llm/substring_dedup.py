"""Substring dedup: repeated windows of consecutive words are removed from all but the first document.

Difference-cover anchors: COVER modulo PERIOD has every difference, so for two places of one 50-word window
there is a shift under PERIOD after which both lie on cover positions; the 50 - PERIOD + 1 words from there on
are a common anchor. Only windows at cover positions are hashed (a fifth of all). Around anchors that stand in
two documents or more, a match is extended: each 50-word window that holds such an anchor is hashed itself and
goes to the smallest document that has it.

Data flow, each step linear in the input whatever the groups of copies:
1. anchors: a task hashes the documents of its split and sorts its anchors. Those found in two documents are
   settled there; of each other anchor one entry goes to the anchor's bucket.
2. anchor buckets, each a task: an anchor met by two tasks is shared; what is shared returns to its document as ranges of
   window starts.
3. windows: document buckets join ranges with texts, hash the windows in these ranges, keep the smallest
   document of each and settle the others; one entry a window goes to the window's bucket.
4. window buckets, each a task: the smallest document over all buckets; the places to remove return to the documents.
5. document buckets cut the words out.
Copies in thousands hence meet as one entry a task or bucket, never as pairs. Texts are shuffled once (steps 3
and 5 read the same exchange). Windows are compared by 96 bits of two independent hashes.

Buckets of documents go by a hash of the id, rows without id by a hash of the text; there are BUCKETS a partition and
a partition for each PARTITION_BYTES of the input at least.

Defined results: null text has no words; a null id counts as the smallest id; rows with the same id are each
cut on their own and never against each other (MOST_ROWS of one id at most, else an error); ids below ALL_NULL are an
error; documents under 50 words lose nothing; empty tables give no
rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, byte_texts, slices, text_partitions
from .rolling import roller

WINDOW = 50
#: A perfect difference set; every residue modulo 31 is a difference of two of its members.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
ORDINAL = 40  # bits of a window start below the number of the row among those with its id
MOST_ROWS = 1 << (63 - ORDINAL)
#: Rows without id are all the same, smallest document: numbers from NULL_ID to here.
ALL_NULL = NULL_ID + (1 << 40)
#: Buckets of documents for each shuffle partition. Buckets of anchors and windows are as many as partitions.
BUCKETS = 2
#: The primes of XXH64.
XXH_PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
BLOB = "bucket long, kind int, a binary, b binary, c binary"


def _blob(bucket: int, kind: int, *arrays: np.ndarray) -> tuple:
    return (bucket, kind, *(x.tobytes() for x in arrays), *[b""] * (3 - len(arrays)))


def _batch(rows: list[tuple], key: str = "bucket") -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[key, "kind", "a", "b", "c"])


def _gather(table: pa.Table, kind: int, *types) -> list[np.ndarray]:
    """The arrays of all blobs of a kind, end to end."""
    wanted = [i for i, k in enumerate(table.column("kind").to_pylist()) if k == kind]
    out = []
    for name, t in zip(("a", "b", "c"), types, strict=False):
        col = table.column(name)
        out.append(np.frombuffer(b"".join(col[i].as_py() for i in wanted), t))
    return out


def _bucket_of(values: np.ndarray, n: int) -> np.ndarray:
    return (values.astype(np.uint64) % np.uint64(n)).astype(np.int64)


def doc_buckets(ids: np.ndarray, n: int) -> np.ndarray:
    """The document bucket of each id, by Spark's 64-bit hash of it; bucket_column() is the same in SQL."""
    a, b, c, d, e = (np.uint64(x) for x in XXH_PRIMES)
    left = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    h = (np.uint64(42 + 8) + e) ^ (left(ids.astype(np.int64).view(np.uint64) * b, 31) * a)
    h = left(h, 27) * a + d
    h = (h ^ (h >> np.uint64(33))) * b
    h = (h ^ (h >> np.uint64(29))) * c
    return np.mod((h ^ (h >> np.uint64(32))).view(np.int64), n)


def bucket_column(id_col: str, n: int) -> F.Column:
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(n)).cast("long")


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text). Rows without id get numbers below ALL_NULL by their texts, so that they spread over the buckets."""
    own = F.col(id_col).cast("long")
    without = F.lit(NULL_ID) + F.pmod(F.xxhash64(text_col), F.lit(ALL_NULL - NULL_ID))
    known = F.when(own < ALL_NULL, F.raise_error(F.lit(f"ids below {ALL_NULL} are not supported")).cast("long")).otherwise(own)
    return docs.select(F.when(own.isNull(), without).otherwise(known).alias("doc_id"), F.col(text_col).alias("text"))


def _split(values: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places) for the buckets that occur, given each entry's bucket."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(values[part[0]]), part


def ranges(ids: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges [first, last] of each id, those that touch joined."""
    if not len(ids):
        return ids, first, last
    order = np.lexsort((first, ids))
    ids, first, last = ids[order], first[order], last[order]
    out_i, out_a, out_b = [], [], []
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], len(ids)], strict=True):
        reach = np.maximum.accumulate(last[a:b])
        new = np.flatnonzero(np.r_[True, first[a + 1 : b] > reach[:-1] + 1])
        out_i.append(np.full(len(new), ids[a], np.int64))
        out_a.append(first[a:b][new])
        out_b.append(reach[np.r_[new[1:] - 1, b - a - 1]])
    return np.concatenate(out_i), np.concatenate(out_a), np.concatenate(out_b)


def _ranges_out(ids: np.ndarray, first: np.ndarray, last: np.ndarray, n: int) -> list[tuple]:
    ids, first, last = ranges(ids, first, last)
    return [_blob(b, 1, ids[at].astype(np.int64), first[at].astype(np.int64), last[at].astype(np.int64)) for b, at in _split(doc_buckets(ids, n), n)]


def _groups(h: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    return np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)


def _spans(ids: np.ndarray) -> dict[int, tuple[int, int]]:
    """Where each id of a sorted array stands."""
    starts = _groups(ids).tolist()
    return {int(ids[a]): (a, b) for a, b in zip(starts, [*starts[1:], len(ids)], strict=False)}


def cover_positions(n: int, cover: tuple[int, ...] = COVER, period: int = PERIOD) -> np.ndarray:
    at = np.add.outer(np.arange(0, max(n, 0), period), np.array(sorted(cover))).reshape(-1)
    return at[at < n]


def duplicated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER, buckets: int | None = None) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256, and kept: its remaining words."""
    if {(a - b) % period for a in cover for b in cover} != set(range(period)) or period > window:
        raise ValueError("the cover must have every difference modulo the period, which is at most the window")
    texts = numbered(docs, id_col, text_col)
    partitions = text_partitions(texts)
    n = buckets or BUCKETS * partitions
    anchor = window - period + 1

    def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, hs, ids, pos = roller(), [], [], []
        for batch in slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), strict=True):
                words = text.split()
                if len(words) < window:
                    continue
                at = cover_positions(len(words) - anchor + 1, cover, period)
                hs.append(rolling.windows(rolling.hashes(words), anchor)[at])
                pos.append(at.astype(np.int32))
                ids.append(np.full(len(at), doc, np.int64))
        if not hs:
            return
        h, doc, at = np.concatenate(hs), np.concatenate(ids), np.concatenate(pos)
        del hs, ids, pos
        order = np.argsort(h, kind="stable")
        h, doc, at = h[order], doc[order], at[order]
        starts = _groups(h)
        shared = np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts)
        member = np.repeat(shared, np.diff(np.r_[starts, len(h)]))
        yield from _out(_ranges_out(doc[member], at[member].astype(np.int64) - (window - anchor), at[member].astype(np.int64), n))
        probe = ~member
        probe[starts[shared]] = True
        at[member] = -1
        h, doc, at = h[probe], doc[probe], at[probe]
        yield from _out([_blob(b, 0, h[i], doc[i], at[i]) for b, i in _split(_bucket_of(h, partitions), partitions)])

    def join_anchors(table: pa.Table) -> pa.Table:
        h, doc, at = _gather(table, 0, np.uint64, np.int64, np.int32)
        rows = []
        if len(h):
            order = np.argsort(h, kind="stable")
            h, doc, at = h[order], doc[order], at[order].astype(np.int64)
            starts = _groups(h)
            shared = (np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts)) | (np.minimum.reduceat(at, starts) < 0)
            member = np.repeat(shared, np.diff(np.r_[starts, len(h)])) & (at >= 0)
            rows = _ranges_out(doc[member], at[member] - (window - anchor), at[member], n)
        return pa.Table.from_batches([_batch(rows + _passed(table))])

    def find_windows(texts: pa.Table, found: pa.Table) -> pa.Table:
        ids, first, last = ranges(*_gather(found, 1, np.int64, np.int64, np.int64))
        rows: list[tuple] = []
        if len(ids):
            rolling, h1s, h2s, docs, at = roller(), [], [], [], []
            span = _spans(ids)
            for doc, ordinal, text in _rows_in_order(texts):
                if doc not in span:
                    continue
                words = text.split()
                a, b = span[doc]
                mask = np.zeros(max(0, len(words) - window + 1) + 1, np.int32)
                np.add.at(mask, np.clip(first[a:b], 0, len(mask) - 1), 1)
                np.add.at(mask, np.clip(last[a:b] + 1, 0, len(mask) - 1), -1)
                starts_in = np.flatnonzero(np.cumsum(mask[:-1]) > 0)
                if len(starts_in):
                    h = rolling.hashes(words)
                    h1s.append(rolling.windows(h, window, 0)[starts_in])
                    h2s.append((rolling.windows(h, window, 1)[starts_in] >> np.uint64(32)).astype(np.uint32))
                    docs.append(np.full(len(starts_in), doc, np.int64))
                    at.append(starts_in + (ordinal << ORDINAL))
            if h1s:
                h1, h2, doc, start = np.concatenate(h1s), np.concatenate(h2s), np.concatenate(docs), np.concatenate(at)
                later = _later(h1, h2, doc)
                rows += _ranges_out(doc[later], start[later], start[later], n)
                h1, h2, doc, start = h1[~later], h2[~later], doc[~later], start[~later]
                key = np.empty(len(h1), "<u8,<u4")
                key["f0"], key["f1"] = h1, h2
                rows += [_blob(b, 0, key[i], doc[i], start[i].astype(np.int64)) for b, i in _split(_bucket_of(h1, partitions), partitions)]
        return pa.Table.from_batches([_batch(rows)])

    def join_windows(table: pa.Table) -> pa.Table:
        key, doc, start = _gather(table, 0, "<u8,<u4", np.int64, np.int64)
        rows = []
        if len(key):
            later = _later(key["f0"], key["f1"], doc)
            rows = _ranges_out(doc[later], start[later], start[later], n)
        return pa.Table.from_batches([_batch(rows + _passed(table))])

    def cut(texts: pa.Table, found: pa.Table) -> pa.Table:
        ids, first, last = ranges(*_gather(found, 1, np.int64, np.int64, np.int64))
        span = _spans(ids)
        cols: list[list] = [[] for _ in range(5)]
        for doc, ordinal, text in _rows_in_order(texts):
            words = text.split()
            left = words
            if doc in span:
                a, b = span[doc]
                own = (first[a:b] >> ORDINAL) == ordinal
                mask = np.zeros(len(words) + 1, np.int32)
                np.add.at(mask, first[a:b][own] & ((1 << ORDINAL) - 1), 1)
                np.add.at(mask, (last[a:b][own] & ((1 << ORDINAL) - 1)) + window, -1)
                keep = np.cumsum(mask[:-1]) == 0
                if not keep.all():
                    left = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
            kept = b" ".join(left)
            for col, v in zip(cols, (doc, len(words), len(words) - len(left), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                col.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
        arrays[4] = arrays[4].cast(pa.string())
        return pa.table(arrays, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    dealt = lambda df: df.repartition(partitions, "bucket").groupBy("bucket")
    met = lambda df, join: df.repartitionById(partitions, F.col("bucket").cast("int")).mapInArrow(_whole(join), BLOB)
    by_doc = dealt(texts.withColumn("bucket", bucket_column("doc_id", n)))
    shared = met(texts.mapInArrow(find_anchors, BLOB), join_anchors)
    windows = by_doc.cogroup(dealt(shared)).applyInArrow(find_windows, BLOB)
    removed = met(windows, join_windows)
    out = by_doc.cogroup(dealt(removed)).applyInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return out.select(F.when(F.col("doc_id") >= ALL_NULL, F.col("doc_id")).alias(id_col), "n_words", "n_removed", "kept_sha256", "kept")


def _whole(join: Callable[[pa.Table], pa.Table]) -> Callable:
    """``join`` of all rows of a partition, which are one bucket of anchors or windows, and ranges that pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from join(pa.Table.from_batches(held)).to_batches(max_chunksize=64)

    return run


def _out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(rows), 64):
        yield _batch(rows[a : a + 64])


def _passed(table: pa.Table) -> list[tuple]:
    """Ranges that were settled before, as they came."""
    return [tuple(r[k] for k in ("bucket", "kind", "a", "b", "c")) for r in table.filter(pa.compute.equal(table.column("kind"), 1)).to_pylist()]


def _later(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which windows also stand in a document with a smaller id, among these. Rows without id have the same, smallest one."""
    doc = np.maximum(doc, ALL_NULL - 1)
    order = np.lexsort((doc, h2, h1))
    a, b, d = h1[order], h2[order], doc[order]
    starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    least = np.repeat(d[starts], np.diff(np.r_[starts, len(d)]))
    out = np.zeros(len(d), bool)
    out[order] = d > least
    return out


def _rows_in_order(texts: pa.Table) -> Iterator[tuple[int, int, bytes]]:
    """(id, number among the rows with this id, text), the same whenever the same rows are given."""
    ids, found = texts.column("doc_id").to_pylist(), byte_texts(texts.column("text").combine_chunks())
    previous, ordinal = None, 0
    for doc, text in sorted(zip(ids, found, strict=True)):
        ordinal = ordinal + 1 if doc == previous else 0
        if ordinal >= MOST_ROWS:
            raise ValueError(f"over {MOST_ROWS} rows share the id {doc}")
        previous = doc
        yield doc, ordinal, text


def oracle(window: int = WINDOW) -> str:
    """The same by grouping all windows of all documents by their words."""
    word = r"[^\x20\x09-\x0D]+"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, -9223372036854775808) AS id, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
win AS (SELECT r, id, i, md5(array_to_string(w[i:i + {window - 1}], ' ')) AS h FROM (SELECT r, id, w, unnest(range(1, len(w) - {window - 2})) AS i FROM d)),
later AS (SELECT r, i FROM (SELECT r, id, i, min(id) OVER (PARTITION BY h) AS first FROM win) WHERE id > first),
gone AS (SELECT r, list_distinct(list(p)) AS places FROM (SELECT r, unnest(range(i, i + {window})) AS p FROM later) GROUP BY r),
flat AS (SELECT r, p, w[p] AS x FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d JOIN gone USING (r))),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t FROM flat ANTI JOIN (SELECT r, unnest(places) AS p FROM gone) USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(places), 0)::BIGINT AS n_removed, sha256(CASE WHEN places IS NULL THEN array_to_string(w, ' ') ELSE coalesce(t, '') END) AS kept_sha256
FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
"""
