"""Exact self-join of documents by the Jaccard similarity of their word n-gram sets, and its components.

A document's set: its distinct shingles of five consecutive words (A-Z in lower case); with fewer words the
whole sequence is one shingle; without words the set is empty. Two documents link at similarity >= 0.75.

The filter is a multi-match prefix. Shingles have one global order, the rarest first by a count sketch of the
whole corpus. If two sets overlap in a = ceil(t |x|) or more, their prefixes of |x| - a + l shingles share at
least l, for every l. Each document takes the l from 1 to MOST_MATCHES with the least estimated cost: what
lies in the posting lists of its prefix, and the candidates left to verify, which fall with l. A pair needs
as many shared prefix shingles as the smaller of its two l. Every pair is put to this test, however it was come by,
and only then are whole sets compared.

Groups of copies are never expanded into pairs:
- documents with the same set form a class, joined through its smallest id;
- a first round pairs class representatives with a pivot or two each, by a few smallest shingle hashes; it merges groups
  of near copies at linear cost. It is no filter: whatever it misses is found next;
- documents with the same hub (a pivot that they share several of these hashes with) meet in blocks, in tasks of
  bounded size with the posting lists of the block's prefixes, that give out links only: those outside of the hub's
  largest component with all;
- the exact round then looks for links between different components and hubs, all of them: a link within a
  component could not change the components. It counts matches between a document and a component (the document's prefix
  shingles that any member of fitting size shares), which is no less than for any single member;
- a document left as candidate of a small component is verified against each member; of a large one in blocks.
Links are verified on whole sets. They never come to the driver.

Defined results: null text counts as empty; empty sets link with nothing; a null id counts as the smallest
id; rows that share an id are one document and link if any of their texts does; empty tables give no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, byte_texts, null_ids, slices, summed, with_ids, written
from .components import components
from .rolling import Roller, mix, roller

N, PERCENT = 5, 75
SKETCH_CELLS, SKETCH_SLICE = 1 << 20, 1 << 14
#: Shingle hashes of a document that the first round groups by.
ANCHORS = 8
MOST_MATCHES, VERIFY_COST = 128, 4.0
#: Components up to SMALL are verified member by member; larger ones in blocks of so many shingles.
SMALL, BLOCK_SHINGLES = 8, 1_000_000
#: Prefix shingles of one token bucket, about: a task of the exact round.
BUCKET_TOKENS = 500_000
#: Shared smallest hashes from which a pivot is a document's hub.
HUB_VOTES = 3
#: Ids that may be sent to all executors; beyond, they are joined.
MOST_BROADCAST = 2_000_000
SIGNATURE = "kind int, doc_id long, n long, s1 long, s2 long, anchors array<long>, slice int, counts binary"
POSTINGS = "bucket long, tokens binary, docs binary, table binary"
TABLE = np.dtype([("doc", "<i8"), ("comp", "<i8"), ("n", "<i4"), ("matches", "<i4"), ("size", "<i8"), ("hub", "<i8")])


def shingles(text: bytes, rolling: Roller, n: int = N) -> np.ndarray:
    """The distinct shingle hashes of a text, rising."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = rolling.hashes(words)
    if len(words) < n:
        return mix(rolling.windows(h, len(words)) + np.uint64(len(words)))
    return np.unique(rolling.windows(h, n))


def need(n, percent: int = PERCENT):
    """ceil(percent / 100 * n): the least overlap of a set of n with any set that is similar enough."""
    return (percent * n + 99) // 100


def similar(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    if not len(x) or not len(y) or min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def signatures(docs: DataFrame, n: int = N, cells: int = SKETCH_CELLS) -> DataFrame:
    """One scan: per document the size and two sums that name its set, and its smallest shingle hashes (kind 0);
    per task the slices of its part of the count sketch (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, sketch, step = roller(), np.zeros(cells, np.uint32), min(SKETCH_SLICE, cells)
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary())
        names = [x.split()[0] for x in SIGNATURE.split(", ")]
        pack = lambda rows: pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), strict=True):
                s = shingles(text, rolling, n)
                np.add.at(sketch, (s % np.uint64(cells)).astype(np.int64), 1)
                sums = (int(mix(s).sum(dtype=np.uint64)), int((mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)) * s).sum(dtype=np.uint64)))
                a, b = (x - (1 << 64) if x >> 63 else x for x in sums)
                rows.append((0, doc, len(s), a, b, s[:ANCHORS].view(np.int64).tolist(), None, None))
            yield pack(rows)
        rows = []
        for k in range(0, cells, step):
            part = sketch[k : k + step]
            at = np.flatnonzero(part)
            if len(at):
                blob = b"s" + at.astype("<u2").tobytes() + part[at].astype("<u4").tobytes() if 6 * len(at) < 4 * step else b"d" + part.astype("<u4").tobytes()
                rows.append((1, None, None, None, None, None, k // step, blob))
        if rows:
            yield pack(rows)

    return docs.mapInArrow(run, SIGNATURE)


def sketch_of(signed: DataFrame, cells: int = SKETCH_CELLS) -> np.ndarray:
    """The count sketch of the whole corpus: SKETCH_CELLS cells at any size of the input."""
    step = min(SKETCH_SLICE, cells)

    def add(blobs: list) -> bytes:
        total = np.zeros(step, np.uint64)
        for blob in blobs:
            if bytes(blob[:1]) == b"d":
                total += np.frombuffer(blob, "<u4", offset=1)
            else:
                k = (len(blob) - 1) // 6
                total[np.frombuffer(blob, "<u2", k, 1)] += np.frombuffer(blob, "<u4", k, 1 + 2 * k)
        return b"d" + np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes()

    out = np.zeros(cells, np.uint32)
    for r in summed(signed.filter("kind = 1").select("slice", F.col("counts").alias("blob")), add).collect():
        out[r["slice"] * step : (r["slice"] + 1) * step] = np.frombuffer(r["blob"], "<u4", offset=1)
    return out


class Order:
    """The global order of shingles as it goes to the executors, and the prefixes it gives."""

    def __init__(self, spark: SparkSession, sketch: np.ndarray, percent: int = PERCENT):
        self.shared, self.floor, self.percent = spark.sparkContext.broadcast(sketch), int(np.median(sketch)) + 1, percent

    def prefix(self, s: np.ndarray) -> tuple[np.ndarray, int]:
        return prefix(s, self.shared.value, self.floor, self.percent)


def prefix(s: np.ndarray, sketch: np.ndarray, floor: int, percent: int = PERCENT) -> tuple[np.ndarray, int]:
    """The prefix of a set and the matches it asks for."""
    size = len(s)
    if not size:
        return s, 1
    count = sketch[(s % np.uint64(len(sketch))).astype(np.int64)]
    order = np.argsort(count, kind="stable")  # of equal counts the smaller hash comes first, as the set is rising
    s, count = s[order], count[order].astype(np.int64)
    base = size - need(size, percent)
    most = min(MOST_MATCHES, need(size, percent))
    listed = np.cumsum(np.maximum(count[: base + most] - floor, 0))
    cost = listed[base : base + most] * (1 + VERIFY_COST / np.arange(1, most + 1))
    matches = int(np.argmin(cost)) + 1
    return s[: base + matches], matches


def _known(spark: SparkSession, table: DataFrame, columns: list[str]):
    """The rows as sorted arrays for a broadcast, or None where they are over MOST_BROADCAST."""
    if table.count() > MOST_BROADCAST:
        return None
    found = table.select(*columns).toArrow()
    arrays = [found.column(c).to_numpy() for c in columns]
    order = np.argsort(arrays[0], kind="stable")
    return spark.sparkContext.broadcast([a[order] for a in arrays])


def _named(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """The documents with these ids, if they are few enough to name to all executors, so that only their texts are
    shuffled by the join that follows; else all documents."""
    known = _known(docs.sparkSession, ids.distinct(), ["doc_id"])
    if known is not None:

        def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (ids,) = known.value
            for batch in batches:
                own = batch.column(0).to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(ids, own), max(len(ids) - 1, 0))
                yield batch.filter(pa.array(ids[at] == own if len(ids) else np.zeros(len(own), bool)))

        return docs.mapInArrow(some, docs.schema)
    return docs


def _with_texts(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(x, y) with the texts of both."""
    docs = _named(pairs.select(F.col("x").alias("doc_id")).union(pairs.select(F.col("y").alias("doc_id"))), docs)
    left = docs.select(F.col("doc_id").alias("x"), F.col("text").alias("x_text"))
    right = docs.select(F.col("doc_id").alias("y"), F.col("text").alias("y_text"))
    return pairs.join(left, "x").join(right, "y").select("x", "y", "x_text", "y_text")


def may_link(x: tuple[np.ndarray, int], y: tuple[np.ndarray, int]) -> bool:
    """Whether two prefixes share as many shingles as the less demanding of them asks for."""
    (p, a), (q, b) = x, y
    return len(np.intersect1d(p, q, assume_unique=True)) >= min(a, b)


def verified(pairs: DataFrame, docs: DataFrame, order: Order, n: int = N, percent: int = PERCENT) -> DataFrame:
    """Those of the pairs (x, y) whose prefixes share enough and whose whole sets are similar enough, as edges (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, last = roller(), None
        y = head = None
        for batch in slices(batches):
            ys, texts, others = batch.column(1).to_pylist(), byte_texts(batch.column(2)), byte_texts(batch.column(3))
            good = []
            for x_text, y_text in zip(texts, others, strict=True):
                if y_text != last:
                    last, y = y_text, shingles(y_text, rolling, n)
                    head = order.prefix(y)
                x = shingles(x_text, rolling, n)
                good.append(may_link(order.prefix(x), head) and similar(x, y, percent))
            keep = pa.array(good, pa.bool_())
            yield pa.record_batch([batch.column(0).filter(keep), pa.array(ys, pa.int64()).filter(keep)], names=["u", "v"])

    return _with_texts(pairs, docs).mapInArrow(run, "u long, v long")


def pivots(members: DataFrame) -> DataFrame:
    """members: (doc_id, anchors) -> (x, y, hub). The pivot of an anchor is its smallest document; y is the one that x
    shares most anchors with, hub the smallest one that it shares HUB_VOTES with, or null."""
    each = members.select("doc_id", F.explode("anchors").alias("anchor"))
    least = each.groupBy("anchor").agg(F.min("doc_id").alias("y"), F.max("doc_id").alias("z")).filter("y < z").select("anchor", "y")
    votes = each.join(least, "anchor").groupBy("doc_id", "y").count()
    best = F.max_by(F.when(F.col("doc_id") != F.col("y"), F.col("y")), F.struct((F.col("doc_id") != F.col("y")).cast("int"), "count", F.bitwise_not("y")))
    return votes.groupBy(F.col("doc_id").alias("x")).agg(best.alias("y"), F.min(F.when(F.col("count") >= HUB_VOTES, F.col("y"))).alias("hub"))


def labelled(batch: pa.RecordBatch, known: list[np.ndarray]) -> pa.RecordBatch:
    """(doc_id, text) with each representative's component, its size, and the hub; copies go."""
    node, component, copy, size, hub = known
    own = batch.column(0).to_numpy(zero_copy_only=False)
    comp, drop, n, hubs = own.copy(), np.zeros(len(own), bool), np.ones(len(own), np.int64), own.copy()
    if len(node):
        at = np.minimum(np.searchsorted(node, own), len(node) - 1)
        hit = node[at] == own
        comp[hit], drop[hit], n[hit], hubs[hit] = component[at[hit]], copy[at[hit]] == 1, size[at[hit]], hub[at[hit]]
    return pa.record_batch([*batch.columns, *(pa.array(x, pa.int64()) for x in (comp, n, hubs))], names=["doc_id", "text", "comp", "size", "hub"]).filter(pa.array(~drop))


def matches(reps: DataFrame, order: Order, known=None, n: int = N, percent: int = PERCENT, buckets: int | None = None) -> DataFrame:
    """reps: (doc_id, text, comp, size, hub), or (doc_id, text) of all documents with the broadcast labels ``known``.

    (x, comp, size, shared, asked) per token bucket: documents and components of other documents, not smaller than
    the document's own, how many of the bucket's tokens they share, and how many a link must share in all."""
    buckets = buckets or 2 * int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = roller()
        tokens, owners, table, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            t, o = np.concatenate(tokens), np.concatenate(owners)
            about = np.array(table, TABLE)
            bucket = (t % np.uint64(buckets)).astype(np.int64)
            by_bucket = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[by_bucket])) + 1
            rows = []
            for part in np.split(by_bucket, cuts):
                used, local = np.unique(o[part], return_inverse=True)
                rows.append((int(bucket[part[0]]), t[part].tobytes(), local.astype("<u4").tobytes(), about[used].tobytes()))
            return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3))], names=["bucket", "tokens", "docs", "table"])

        for batch in slices(batches):
            if known is not None:
                batch = labelled(batch, known.value)
            for doc, text, comp, size, hub in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), *(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                s = shingles(text, rolling, n)
                if not len(s):
                    continue
                p, matches = order.prefix(s)
                tokens.append(p)
                owners.append(np.full(len(p), len(table), np.int64))
                table.append((doc, comp, len(s), matches, size, hub))
                held += len(p)
                if held > 1_500_000:
                    yield flush()
                    tokens, owners, table, held = [], [], [], 0
        if table:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from met(pa.Table.from_batches(held)).to_batches()

    def met(t: pa.Table) -> pa.Table:
        tokens = np.concatenate([np.frombuffer(b.as_py(), np.uint64) for b in t.column("tokens")])
        tables = [np.frombuffer(b.as_py(), TABLE) for b in t.column("table")]
        base = np.cumsum([0, *map(len, tables)])
        owner = np.concatenate([np.frombuffer(b.as_py(), "<u4").astype(np.int64) + k for b, k in zip(t.column("docs"), base, strict=False)])
        about = np.concatenate(tables)
        by_token = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[by_token], owner[by_token]
        starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        comps, first_of, comp = np.unique(about["comp"], return_index=True, return_inverse=True)
        hubs = about["hub"]
        rank = np.empty(len(comps), np.int64)
        rank[np.lexsort((comps, about["size"][first_of]))] = np.arange(len(comps))  # by size, then id
        mixed = np.minimum.reduceat(comp[owner], starts) < np.maximum.reduceat(comp[owner], starts)
        ends = np.r_[starts[1:], len(tokens)]
        pairs, counts, asked = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def settle() -> None:
            nonlocal pairs, counts, asked, found, held
            every = np.concatenate([pairs, *(f[0] for f in found)])
            weight = np.concatenate([counts, np.ones(len(every) - len(pairs), np.int64)])
            least = np.concatenate([asked, *(f[1] for f in found)])
            pairs, inverse = np.unique(every, return_inverse=True)
            counts = np.bincount(inverse, weight, len(pairs)).astype(np.int64)
            asked = np.full(len(pairs), 1 << 30, np.int64)
            np.minimum.at(asked, inverse, least)
            found, held = [], 0

        for a, b in zip(starts[mixed].tolist(), ends[mixed].tolist(), strict=True):
            own = np.unique(owner[a:b])
            own = own[np.lexsort((about["n"][own], hubs[own], comp[own]))]
            c, h, size, asks = comp[own], hubs[own], about["n"][own].astype(np.int64), about["matches"][own].astype(np.int64)
            rest = need(size, percent) - asks
            cuts = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (h[1:] != h[:-1]), True])
            codes, least = [], []
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):  # all documents against c[i]'s of one hub
                low = np.searchsorted(size[i:j], need(size, percent))
                high = np.searchsorted(size[i:j], 100 * size // percent, side="right")
                x = np.flatnonzero((low < high) & (rank[c] < rank[c[i]]) & (h != h[i]))
                if len(x):
                    # a link shares that many of the prefixes, and all it needs but what lies behind the one that ends first
                    overlap = -(-percent * (size[x] + size[i + low[x]]) // (100 + percent))
                    behind = np.maximum(rest[x], rest[i:j].max())
                    codes.append(own[x] * len(comps) + c[i])
                    least.append(np.maximum(np.minimum(asks[x], asks[i:j].min()), overlap - behind))
            if codes:
                code, asked_least = np.concatenate(codes), np.concatenate(least)
                by_code = np.lexsort((asked_least, code))
                code, asked_least = code[by_code], asked_least[by_code]
                once = np.r_[True, code[1:] != code[:-1]]
                found.append((code[once], asked_least[once]))
                held += int(once.sum())
            if held > 1_000_000:
                settle()
        settle()
        target = pairs % len(comps)
        return pa.table({"x": about["doc"][pairs // len(comps)], "comp": comps[target], "size": about["size"][first_of[target]], "shared": counts, "asked": asked})

    posted = reps.mapInArrow(post, POSTINGS).repartitionById(buckets, F.col("bucket").cast("int"))  # a bucket is a task
    return posted.mapInArrow(meet, "x long, comp long, size long, shared long, asked long")


def candidates(reps: DataFrame, order: Order, known=None, n: int = N, percent: int = PERCENT, buckets: int | None = None) -> DataFrame:
    """All (x, comp, size) that share enough of their prefixes for a link with any member."""
    met = matches(reps, order, known, n, percent, buckets)
    return met.groupBy("x", "comp").agg(F.max("size").alias("size"), F.sum("shared").alias("shared"), F.min("asked").alias("asked")).filter("shared >= asked").select("x", "comp", "size")


def _by_group(rows: DataFrame, table: DataFrame, size: str) -> DataFrame:
    """rows joined with a written table of their groups. The table is sent to the rows, which hence stay where they are;
    of a table of over MOST_BROADCAST groups only those of over BLOCK_SHINGLES are, and the others are shuffled."""
    if table.count() <= MOST_BROADCAST:
        return rows.join(F.broadcast(table), "group")
    heavy = table.filter(F.col(size) > BLOCK_SHINGLES)
    light = rows.join(F.broadcast(heavy.select("group")) if heavy.count() <= abs(MOST_BROADCAST) else heavy.select("group"), "group", "left_anti")
    return rows.join(F.broadcast(heavy) if heavy.count() <= abs(MOST_BROADCAST) else heavy, "group").unionByName(light.join(table, "group"))


def verified_blocks(xs: DataFrame, ys: DataFrame, docs: DataFrame, order: Order, n: int = N, percent: int = PERCENT) -> DataFrame:
    """xs, ys: (group, doc_id, comp, n). For each x, a link (u, v) with each other component of its group's ys, if one
    of it has a prefix that shares enough and a whole set that is similar enough. The xs and ys of a group meet in blocks
    of BLOCK_SHINGLES shingles: a text goes to as many tasks as the other side has blocks."""
    parts = lambda df, name: df.groupBy("group").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias(name), F.sum("n").alias(f"{name}_n"))
    shape = parts(xs, "ni").join(parts(ys, "nj"), "group").select("group", "ni", "nj", (F.col("ni_n") + F.col("nj_n")).alias("_n"))
    shape = written(shape, "shapes")
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = _by_group(xs, shape, "_n").select("group", "doc_id", "comp", F.lit(0).alias("side"), F.pmod(F.xxhash64("doc_id"), "ni").alias("i"), upto("nj").alias("j"))
    right = _by_group(ys, shape, "_n").select("group", "doc_id", "comp", F.lit(1).alias("side"), upto("ni").alias("i"), F.pmod(F.xxhash64("doc_id"), "nj").alias("j"))
    placed = written(left.unionAll(right), "blocks")

    def compare(table: pa.Table) -> pa.Table:
        rolling = roller()
        sides = np.array(table.column("side").to_pylist())
        ids = np.array(table.column("doc_id").to_pylist(), np.int64)
        comp = np.array(table.column("comp").to_pylist(), np.int64)
        sets = [shingles(t, rolling, n) for t in byte_texts(table.column("text").combine_chunks())]
        ys = np.flatnonzero(sides == 1)
        links: list[tuple[int, int]] = []
        if len(ys):
            heads = [order.prefix(sets[k]) for k in ys.tolist()]
            asked = np.array([a for _, a in heads])
            sizes = np.array([len(sets[k]) for k in ys])
            index = Postings([p for p, _ in heads])
            whole: Postings | None = None
            for k in np.flatnonzero(sides == 0).tolist():
                x, (head, asks) = sets[k], order.prefix(sets[k])
                close = (percent * sizes <= 100 * len(x)) & (percent * len(x) <= 100 * sizes) & (comp[ys] != comp[k])
                some = np.flatnonzero(close & (index.shared(head) >= np.minimum(asked, asks)))
                if len(some) > 8 and whole is None:
                    whole = Postings([sets[j] for j in ys.tolist()])
                both = whole.shared(x)[some] if len(some) > 8 else np.array([len(np.intersect1d(x, sets[ys[j]], assume_unique=True)) for j in some.tolist()], np.int64)
                good = ys[some[100 * both >= percent * (sizes[some] + len(x) - both)]]
                _, first = np.unique(comp[good], return_index=True)
                links += [(int(ids[k]), int(ids[g])) for g in good[first]]
        return pa.table({"u": pa.array([u for u, _ in links], pa.int64()), "v": pa.array([v for _, v in links], pa.int64())})

    return placed.join(_named(placed.select("doc_id"), docs), "doc_id").groupBy("group", "i", "j").applyInArrow(compare, "u long, v long")


class Postings:
    """The documents of a block by their shingles."""

    def __init__(self, lists: list[np.ndarray]):
        self.n, tokens = len(lists), np.concatenate(lists)
        by_token = np.argsort(tokens, kind="stable")
        self.tokens, self.owner = tokens[by_token], np.repeat(np.arange(self.n), [len(x) for x in lists])[by_token]

    def shared(self, x: np.ndarray) -> np.ndarray:
        """How many of x each document has."""
        a, b = np.searchsorted(self.tokens, x), np.searchsorted(self.tokens, x, side="right")
        at = np.repeat(a, b - a) + np.arange(int((b - a).sum())) - np.repeat(np.cumsum(b - a) - (b - a), b - a)
        return np.bincount(self.owner[at], minlength=self.n)


def similarity_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT, cells: int = SKETCH_CELLS, buckets: int | None = None) -> DataFrame:
    """One row per document: its id, n_shingles, component_id (the smallest id that links reach)."""
    spark = docs.sparkSession
    texts = with_ids(docs.select(id_col, text_col), id_col).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed = written(signatures(texts, n, cells), "signatures")
    order = Order(spark, sketch_of(signed, cells), percent)
    each = signed.filter("kind = 0 AND n > 0")
    classes = written(each.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.min("anchors").alias("anchors")), "classes")
    links = written(each.join(classes.drop("anchors"), ["n", "s1", "s2"]).filter("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")), "class_links")

    reps_n = classes.groupBy(F.col("rep").alias("doc_id")).agg(F.max("n").alias("n"))
    first = written(pivots(classes.select(F.col("rep").alias("doc_id"), "anchors").dropDuplicates(["doc_id", "anchors"])), "pivots")
    pairs = first.select("x", "y").union(first.select("x", F.col("hub").alias("y"))).filter("x <> y").distinct()
    near = written(verified(pairs, texts, order, n, percent), "near")
    merged = components(near)  # of representatives; copies are no candidates
    sizes = merged.groupBy("component").agg((F.count("*") + 1).alias("size"))
    comps = merged.join(sizes, "component").select("node", "component", "size").union(sizes.select(F.col("component").alias("node"), "component", "size"))
    hubs = first.filter("hub IS NOT NULL").select(F.col("x").alias("node"), "hub")
    of_reps = comps.join(hubs, "node", "full").select("node", F.coalesce("component", "node").alias("component"), F.coalesce("size", F.lit(1)).alias("size"), F.coalesce("hub", "node").alias("hub"), F.lit(0).alias("copy"))
    copies = links.select(F.col("u").alias("node")).join(classes.select(F.col("rep").alias("node")), "node", "left_anti").select("node", F.lit(NULL_ID).alias("component"), F.lit(0).cast("long").alias("size"), F.lit(NULL_ID).alias("hub"), F.lit(1).alias("copy"))
    labels = written(of_reps.union(copies), "labels")
    known = _known(spark, labels, ["node", "component", "copy", "size", "hub"])
    reps = texts
    if known is None:
        own = texts.join(labels.withColumn("hit", F.lit(True)), F.col("doc_id") == F.col("node"), "left").filter("hit IS NULL OR copy = 0")
        reps = own.select("doc_id", "text", F.coalesce("component", "doc_id").alias("comp"), F.coalesce("size", F.lit(1)).alias("size"), F.coalesce("hub", "doc_id").alias("hub"))
    if buckets is None:
        tokens = signed.filter("kind = 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"] * (100 - percent) // 100
        buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // BUCKET_TOKENS))
    found = written(candidates(reps, order, known, n, percent, buckets), "candidates")
    members = labels.filter("copy = 0").select(F.col("component").alias("comp"), F.col("node").alias("doc_id"), "hub").join(reps_n, "doc_id")
    single = found.filter("size = 1").select("x", F.col("comp").alias("y"))
    several = found.filter(F.col("size").between(2, SMALL)).join(members, "comp").select("x", F.col("doc_id").alias("y"))
    large = found.filter(F.col("size") > SMALL).select(F.col("comp").alias("group"), F.col("x").alias("doc_id"), F.col("x").alias("comp")).join(reps_n, "doc_id")
    by_comp = members.select(F.col("comp").alias("group"), "doc_id", "comp", "n")
    by_hub = members.select(F.col("hub").alias("group"), "doc_id", "comp", "n")
    each_comp = by_hub.groupBy("group", "comp").agg(F.count("*").alias("count"), F.sum("n").alias("n"))
    most = each_comp.groupBy("group").agg(F.max_by("comp", F.struct("count", "comp")).alias("_most"), F.sum("n").alias("_n"), F.count("*").alias("_comps"))
    apart = _by_group(by_hub, written(most.filter("_comps > 1"), "hubs"), "_n").filter("comp <> _most")
    columns = ["group", "doc_id", "comp", "n"]
    far = verified(written(single.union(several), "pairs"), texts, order, n, percent)
    far = far.union(verified_blocks(large.select(columns), by_comp.select(columns), texts, order, n, percent))
    far = far.union(verified_blocks(apart.select(columns), by_hub.select(columns), texts, order, n, percent))
    final = components(links.union(near).union(far))
    out = signed.filter("kind = 0").join(final, F.col("doc_id") == F.col("node"), "left")
    return out.select(null_ids("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")).withColumn("component_id", null_ids("component_id"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its component, one row a document."""
    found = similarity_components(docs, id_col, text_col)
    own = found.withColumn("_own", F.col(id_col).eqNullSafe(F.col("component_id"))).groupBy(id_col).agg(F.max("_own").alias("_own"), F.count("*").alias("_rows"))
    own = written(own.select(F.coalesce(id_col, F.lit(NULL_ID)).alias("_id"), "_own", "_rows"), "own")
    gone = _known(docs.sparkSession, own.filter("NOT _own").select("_id"), ["_id"])
    docs_ids = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))
    if gone is None:
        kept = docs.join(own.filter("NOT _own"), docs_ids == F.col("_id"), "left_anti")
    else:
        at = docs.columns.index(id_col)

        def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (ids,) = gone.value
            for batch in batches:
                values = batch.column(at).cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
                k = np.minimum(np.searchsorted(ids, values), max(len(ids) - 1, 0))
                yield batch.filter(pa.array(ids[k] != values if len(ids) else np.ones(len(values), bool)))

        kept = docs.mapInArrow(only, docs.schema)
    repeated = own.filter("_own AND _rows > 1")
    if repeated.isEmpty():
        return kept
    one = kept.join(repeated, docs_ids == F.col("_id"), "left_semi").dropDuplicates([id_col])
    return kept.join(repeated, docs_ids == F.col("_id"), "left_anti").union(one)


def oracle(n: int = N, percent: int = PERCENT) -> str:
    """The same by counting the shingles that any two different sets share, and following links from every document."""
    upper, word = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"[^\x20\x09-\x0D]+"
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(doc_id, {NULL_ID}) AS id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{word}') AS w FROM documents),
sets AS MATERIALIZED (SELECT doc_id, id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
         ELSE list_sort(list_distinct(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' ')))) END AS s FROM d),
kinds AS MATERIALIZED (SELECT s, min(id) AS k, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
held AS MATERIALIZED (SELECT row_number() OVER (ORDER BY k, n) AS c, k, n, s FROM kinds),
shingle AS MATERIALIZED (SELECT c, n, md5(unnest(s)) AS g FROM held),
pair AS (SELECT a.c AS a, b.c AS b FROM shingle a JOIN shingle b ON a.g = b.g AND a.c < b.c AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
         GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
member AS MATERIALIZED (SELECT DISTINCT id, c FROM sets JOIN held ON sets.s = held.s),
link AS MATERIALIZED (SELECT DISTINCT x.id AS u, held.k AS v FROM member x JOIN held USING (c) UNION SELECT held.k, x.id FROM member x JOIN held USING (c)
         UNION SELECT p.k, q.k FROM pair JOIN held p ON p.c = pair.a JOIN held q ON q.c = pair.b UNION SELECT q.k, p.k FROM pair JOIN held p ON p.c = pair.a JOIN held q ON q.c = pair.b),
reach(id, other) AS (SELECT DISTINCT id, id FROM sets UNION SELECT reach.id, link.v FROM reach JOIN link ON link.u = reach.other),
comp AS (SELECT id, min(other) AS m FROM reach GROUP BY id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, nullif(m, {NULL_ID})::BIGINT AS component_id FROM sets JOIN comp USING (id)
"""
