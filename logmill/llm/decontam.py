"""Benchmark decontamination by latent semantic retrieval.

1. Documents become ids of the benchmark's words (other words are one id), and for each of these words the
   number of passages with it is counted over the whole corpus. Words in more than 1 / STOP of all passages
   carry no weight; the others log(passages / passages with it).
2. Randomised SVD of the TF-IDF matrix A of all passages: every task multiplies its passages with a random
   matrix W, A'(A W) is summed over the tasks, and the Nystroem formula gives the first right singular vectors
   and values from that one pass. Its size depends on the benchmark and RANK only.
3. Search: documents are looked at in windows of three sizes that overlap by half, so an item lies whole in a
   window of at most twice the next power of two of its length. An item is indexed under the places of its
   rarest words: PARAPHRASE of all its places in a window leave at least k of any (places - needed + k) in it, so a
   window with less is no leak, and no other window is left out (prefix filter with k matches).
4. Candidates are checked: the longest common subsequence of item and window (bit-parallel, exact, on word
   ids) must hold NEAR of the item's words; or PARAPHRASE of them if also ANSWER of the item's answer, its last
   quarter of words, stands in order in the window. So all windows that pass are found, at any size of the benchmark
   and for items of stop words too.
5. Findings have the cosine of window and item, folded in (scaled by the inverse singular values). It tells windows
   with the same count apart and drops none.

The benchmark is what is broadcast, at most MOST_ITEM_WORDS of it at a time. The texts are read once; ids go to the shared
folder. Nothing is shuffled but sums and findings, so no document, source or passage can skew a task.

Defined results: null text has no words; null ids stay null in documents and items; repeated rows and items
are reported each; items without words are ignored; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, slices, summed, written
from .licenses import words

BLOCK, PASSAGE = 16, 64
STOP, RANK = 200, 192
NEAR, PARAPHRASE, ANSWER = 0.8, 0.6, 0.75
#: Of the places that a leak needs, those that must stand among the indexed ones. Any value finds the same leaks.
INDEXED = 0.3
MOST_ITEM_WORDS = 200_000
#: Words of documents that are searched at one time, and index entries of their windows.
SEARCHED_WORDS = 40_000
MOST_ENTRIES = 4_000_000
SEED = 11
FOUND = "doc_id long, item_id long, start_word long, n_words long, cosine double, lcs long, item_words long, answer double"


def text_words(text: str | None) -> list[bytes]:
    """Runs of letters and digits (of ASCII; all other characters count as letters), in lower case."""
    return words((text or "").lower().encode())


def common_length(item: dict[int, int], size: int, window: list[int]) -> int:
    """Length of the longest common subsequence; item: for each id a bit mask of its places."""
    row = full = (1 << size) - 1
    get = item.get
    for w in window:
        m = get(w)
        if m is not None:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return size - row.bit_count()


def masks(ids: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(ids):
        out[w] = out.get(w, 0) | 1 << i
    return out


class Item:
    def __init__(self, item_id, ids: list[int]):
        self.item_id, self.ids, self.size = item_id, ids, len(ids)
        self.masks = masks(ids)
        self.need = next(k for k in range(self.size + 1) if k >= PARAPHRASE * self.size)
        tail = ids[-max(1, -(-len(ids) // 4)) :]
        self.answer, self.n_answer = masks(tail), len(tail)
        self.blocks = 1  # of a half window
        while self.blocks * BLOCK < self.size:
            self.blocks *= 2

    def check(self, window: list[int]) -> tuple[int, float] | None:
        lcs = common_length(self.masks, self.size, window)
        if lcs < self.need:
            return None
        answer = common_length(self.answer, self.n_answer, window) / self.n_answer
        return (lcs, answer) if lcs >= NEAR * self.size or answer >= ANSWER else None


class Benchmark:
    """The items as word ids; 0 is any other word."""

    def __init__(self, rows: list[tuple]):
        self.vocabulary: dict[bytes, int] = {}
        self.items = []
        for item_id, text in rows:
            found = text_words(text)
            if found:
                self.items.append(Item(item_id, [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found]))
        self.n = len(self.vocabulary) + 1


def _ids(docs: DataFrame, vocabulary, n: int) -> DataFrame:
    """kind 0: a document's word ids; kind 1: a task's passages and its number of passages by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        names = ["kind", "doc_id", "ids"]
        number = lambda w: known.get(w, 0)
        count, passages = np.zeros(n, np.int64), 0
        for batch in slices(batches):
            ids = [np.fromiter(map(number, text_words(t)), np.uint32) for t in batch.column(1).to_pylist()]
            starts, base = [], 0
            for a in ids:
                k = -(-len(a) // PASSAGE)
                starts.append(np.repeat(np.arange(base, base + k), PASSAGE)[: len(a)])
                base += k
            if base:
                code = np.unique(np.concatenate(starts) * n + np.concatenate(ids))
                count += np.bincount(code % n, minlength=n)
                passages += base
            yield pa.record_batch([pa.array([0] * len(ids), pa.int32()), batch.column(0).cast(pa.int64()), pa.array([a.tobytes() for a in ids], pa.binary())], names=names)
        count[0] = passages
        yield pa.record_batch([pa.array([1], pa.int32()), pa.array([None], pa.int64()), pa.array([count.tobytes()], pa.binary())], names=names)

    return docs.mapInArrow(run, "kind int, doc_id long, ids binary")


def _adder(dtype: str):
    def add(blobs: list) -> bytes:
        total = np.frombuffer(blobs[0], dtype).astype(np.float64 if dtype == "<f4" else np.int64)
        for b in blobs[1:]:
            total += np.frombuffer(b, dtype)
        return total.astype(dtype).tobytes()

    return add


def weights(count: np.ndarray) -> np.ndarray:
    """Per word id: log(passages / passages with it); 0 for other words and stop words."""
    passages = max(1, int(count[0]))
    out = np.log((passages + 1) / (count + 1.0))
    out[count * STOP > np.maximum(passages, STOP)] = 0
    out[0] = 0
    return out.astype(np.float32)


def _weighted_rows(ids: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the passages with weight: word ids, normalised weights, and where each passage begins."""
    at = np.flatnonzero(weight[ids] > 0)
    w, row = ids[at], at // PASSAGE
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(at) else at
    return w, weight[w], starts


def range_sums(ids: DataFrame, weight, rank: int, seed: int = SEED) -> np.ndarray:
    """A'(A W) for all passages. A slice of 128 words of the benchmark is a row of the sum."""
    n = len(weight.value)
    step = 128

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = weight.value
        random = np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (n, rank))
        total = np.zeros((n, rank), np.float32)

        def multiply(parts: list) -> None:
            w = np.concatenate([p[0] for p in parts])
            v = np.concatenate([p[1] for p in parts])
            offsets = np.cumsum([0, *(len(p[0]) for p in parts)])
            starts = np.concatenate([p[2] + o for p, o in zip(parts, offsets, strict=False)])
            lengths = np.diff(np.r_[starts, len(w)])
            v = v / np.repeat(np.sqrt(np.add.reduceat(v * v, starts)), lengths)
            row = np.repeat(np.arange(len(starts)), lengths)
            order = np.argsort(w, kind="stable")
            product = np.add.reduceat(random[w] * v[:, None], starts, axis=0)
            firsts = np.flatnonzero(np.r_[True, w[order][1:] != w[order][:-1]])
            total[w[order][firsts]] += np.add.reduceat(product[row[order]] * v[order][:, None], firsts, axis=0)

        parts, held = [], 0
        for batch in slices(batches):
            for blob in batch.column(0):
                part = _weighted_rows(np.frombuffer(blob.as_buffer(), np.uint32), own)
                if len(part[0]):
                    parts.append(part)
                    held += len(part[0])
                if held > 10_000:
                    multiply(parts)
                    parts, held = [], 0
        if parts:
            multiply(parts)
        rows = [(k // step, total[k : k + step].tobytes()) for k in range(0, n, step)]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["slice", "blob"])

    spark = ids.sparkSession
    tasks = max(1, min(ids.rdd.getNumPartitions(), 2 * spark.sparkContext.defaultParallelism))
    sums = summed(ids.select("ids").coalesce(tasks).mapInArrow(run, "slice int, blob binary"), _adder("<f4"))
    out = np.zeros((n, rank), np.float32)
    for r in sums.collect():
        part = np.frombuffer(r["blob"], "<f4").reshape(-1, rank)
        out[r["slice"] * step : r["slice"] * step + len(part)] = part
    return out


def singular_vectors(ranged: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Right singular vectors over their singular values, from Y = A'A W and W'Y (Nystroem)."""
    n, rank = ranged.shape
    random = np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (n, rank))
    y = ranged.astype(np.float64)
    core = random.T.astype(np.float64) @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > max(values[-1], 0) * 1e-6
    if not good.any():
        return np.zeros((n, 1), np.float32)
    u, s, _ = np.linalg.svd(y @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    return (u / np.maximum(s, 1e-9)).astype(np.float32)


class Postings:
    """Items of one window size under their rarest words: for a word, items and the number of its indexed places."""

    def __init__(self, items: list[Item], own: list[int], count: np.ndarray):
        self.own, words_of, items_of = np.array(own, np.int64), [], []
        self.least = np.zeros(len(own), np.int64)
        for j, i in enumerate(own):
            item = items[i]
            k = max(1, math.ceil(INDEXED * item.need))
            rare = sorted(item.ids, key=lambda w: (count[w], w))[: item.size - item.need + k]
            self.least[j] = k
            words_of += rare
            items_of += [j] * len(rare)
        code, self.places = np.unique(np.array(words_of, np.int64) * len(own) + np.array(items_of, np.int64), return_counts=True)
        self.item = code % len(own)
        self.start = np.searchsorted(code // len(own), np.arange(len(count) + 1))
        self.degree = np.diff(self.start)

    def candidates(self, window: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and their items that hold enough of the indexed places; (window, word): distinct, by window."""
        windows, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        ends = np.flatnonzero(np.r_[window[1:] != window[:-1], True]) + 1 if len(window) else window
        entries, a = np.cumsum(self.degree[word]), 0
        while a < len(window):
            z = int(ends[max(np.searchsorted(ends, a, "right"), np.searchsorted(entries[ends - 1], MOST_ENTRIES + (entries[a - 1] if a else 0), "right") - 1)])
            degree = self.degree[word[a:z]]
            at = np.repeat(self.start[word[a:z]] - (np.cumsum(degree) - degree), degree) + np.arange(int(degree.sum()))
            cell, back = np.unique(np.repeat(window[a:z], degree) * len(self.own) + self.item[at], return_inverse=True)
            hit = cell[np.bincount(back, self.places[at], len(cell)) >= self.least[cell % len(self.own)]]
            windows.append(hit // len(self.own))
            items.append(self.own[hit % len(self.own)])
            a = z
        return np.concatenate(windows), np.concatenate(items)


class Searcher:
    def __init__(self, rows: list[tuple], count: np.ndarray, weight: np.ndarray, vectors: np.ndarray):
        self.items, self.n = Benchmark(rows).items, len(weight)
        self.fold = vectors * weight[:, None]
        latent = np.stack([self.fold[item.ids].sum(axis=0) for item in self.items])
        self.latent = latent / np.maximum(np.linalg.norm(latent, axis=1), 1e-9)[:, None]
        self.sizes: dict[int, Postings] = {}
        for blocks in sorted({x.blocks for x in self.items}):
            self.sizes[blocks] = Postings(self.items, [i for i, x in enumerate(self.items) if x.blocks == blocks], count)

    def search(self, docs: list[np.ndarray]) -> list[list[tuple[int, int, int, float, int, float]]]:
        """Per document its best finding of each item: (item, start, words, cosine, lcs, answer)."""
        lengths = np.array([len(d) for d in docs])
        n_blocks = -(-lengths // BLOCK)
        word = np.concatenate(docs).astype(np.int64)
        owner = np.repeat(np.arange(len(docs)), lengths)
        place = np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        found: list[list] = [[] for _ in docs]
        for blocks, postings in self.sizes.items():
            size = blocks * BLOCK  # of a half; a window is a half and the next one
            windows = np.where(n_blocks > 0, np.maximum(1, -(-n_blocks // blocks) - 1), 0)
            base = np.cumsum(windows) - windows
            some = postings.degree[word] > 0
            half, own, w = place[some] // size, owner[some], word[some]
            first, second = half < windows[own], half > 0
            code = np.unique(np.r_[(base[own] + half)[first], (base[own] + half - 1)[second]] * self.n + np.r_[w[first], w[second]])
            for window, i in zip(*postings.candidates(code // self.n, code % self.n), strict=True):
                k = int(np.searchsorted(base, window, "right")) - 1
                self._check(docs[k], int(i), int(window - base[k]) * size, found[k])
        return [self._best(f) for f in found]

    def _check(self, doc: np.ndarray, i: int, a: int, found: list) -> None:
        item = self.items[i]
        window = doc[a : a + 2 * item.blocks * BLOCK]
        if (hit := item.check(window.tolist())) is not None:
            vector = self.fold[window].sum(axis=0)
            cosine = float(vector @ self.latent[i]) / max(float(np.linalg.norm(vector)), 1e-6)
            found.append((i, a, len(window), cosine, *hit))

    @staticmethod
    def _best(found: list) -> list:
        best: dict[int, tuple] = {}
        for f in found:
            if f[0] not in best or (f[4], f[3], -f[1]) > (best[f[0]][4], best[f[0]][3], -best[f[0]][1]):
                best[f[0]] = f
        return [best[i] for i in sorted(best)]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rank: int = RANK) -> DataFrame:
    """One row (FOUND) per document and benchmark item that leaked into it: the window with the most of it. A benchmark of
    over MOST_ITEM_WORDS words (by 8 characters each) is searched in parts, each as one of its own."""
    size = benchmark.agg(F.coalesce(F.sum(F.length(item_text)), F.lit(0)).alias("n"), F.count("*").alias("rows")).first()
    parts = max(1, -(-size["n"] // (8 * MOST_ITEM_WORDS)), -(-size["rows"] // MOST_ITEM_WORDS))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    of = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    found = [_find_leaks(docs, items.filter(of == k) if parts > 1 else items, id_col, text_col, rank) for k in range(parts)]
    return reduce(DataFrame.unionAll, found).withColumnsRenamed({"doc_id": id_col, "item_id": item_col})


def _find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, rank: int) -> DataFrame:
    spark = docs.sparkSession
    context = spark.sparkContext
    rows = sorted(((r[0], r[1]) for r in benchmark.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    schema = FOUND
    known = Benchmark(rows)
    if not known.items:
        return spark.createDataFrame([], schema)
    vocabulary = context.broadcast(known.vocabulary)
    ids = written(_ids(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col), vocabulary, known.n), "word_ids")
    counts = summed(ids.filter("kind = 1").select(F.lit(0).alias("slice"), F.col("ids").alias("blob")), _adder("<i8"), (64 << 20) // (8 * known.n))
    (count,) = [np.frombuffer(r["blob"], "<i8") for r in counts.collect()] or [np.zeros(known.n, np.int64)]
    weight = weights(count)
    ids = ids.filter("kind = 0")
    shared, counted = context.broadcast(weight), context.broadcast(count)
    vectors = context.broadcast(singular_vectors(range_sums(ids, shared, min(rank, known.n))))
    items = context.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(items.value, counted.value, shared.value, vectors.value)
        for batch in slices(batches):
            keys, docs, held, out = [], [], 0, []

            def settle() -> None:
                nonlocal keys, docs, held
                for doc_id, found in zip(keys, searcher.search(docs), strict=True):
                    out.extend((doc_id, searcher.items[i].item_id, a, n, c, lcs, searcher.items[i].size, answer) for i, a, n, c, lcs, answer in found)
                keys, docs, held = [], [], 0

            for doc_id, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys.append(doc_id)
                docs.append(np.frombuffer(blob.as_buffer(), np.uint32))
                held += len(docs[-1])
                if held > SEARCHED_WORDS:
                    settle()
            if docs:
                settle()
            if out:
                kinds = [pa.int64()] * 4 + [pa.float64(), pa.int64(), pa.int64(), pa.float64()]
                yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in schema.split(", ")])

    return ids.select("doc_id", "ids").mapInArrow(run, schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_broadcast: int = 2_000_000) -> DataFrame:
    """The rows of ``docs`` into which no item leaked. Rows that share an id go together, and so do rows without id."""
    leaks = written(find_leaks(docs, benchmark, id_col, text_col).select(F.coalesce(id_col, F.lit(NULL_ID)).alias("_leak")).distinct(), "leaks")
    small = leaks.count() <= most_broadcast
    return docs.join(F.broadcast(leaks) if small else leaks, F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)) == F.col("_leak"), "left_anti")
