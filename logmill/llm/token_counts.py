"""Token counts of whole texts by byte-pair merging with a heap and a linked list, without making ids.

Texts are cut into pretokens as the byte-level tokenizer does; the symbols of a pretoken form a linked list, a
heap holds the adjacent pairs by rank, and the lowest pair is merged until none has a rank. The count is the
number of first symbols less the merges. Counts of recent pretokens are kept, so each is merged once a worker.

Defined results: null text counts as empty (0 bytes, 0 tokens); a null id stays null; each row is counted on
its own; empty tables give no rows; further columns are ignored. Strings of special tokens count as one each.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import per_worker, slices
from .tokens import Recent, blocks, cutter, is_byte_level, read_spec

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: The byte-level pretoken rule, for texts with characters of any kind.
FULL_PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    own = {b for first, last in (("!", "~"), ("\xa1", "\xac"), ("\xae", "\xff")) for b in range(ord(first), ord(last) + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Counter:
    """count(texts): tokens of each text."""

    def __init__(self, spec: str, most_pretokens: int = 300_000):
        parsed = json.loads(spec)
        if not is_byte_level(parsed):
            raise ValueError("only byte-level BPE tokenizer files are counted here")
        pairs = (m.split(" ") if isinstance(m, str) else m for m in parsed["model"]["merges"])
        self.rank = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.whole = set(parsed["model"]["vocab"]) if parsed["model"].get("ignore_merges") else set()
        self.letter = byte_letters()
        specials = [t["content"] for t in parsed.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.known = Recent(lambda new: [self.merge(p) for p in new], most_pretokens)

    def merge(self, pretoken: str) -> int:
        letter = self.letter
        symbols: list[str | None] = [letter[b] for b in pretoken.encode()]
        n = len(symbols)
        if n < 2 or (self.whole and "".join(symbols) in self.whole):
            return min(n, 1)
        rank = self.rank.get
        heap = [(r, i, p) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := rank(p)) is not None]
        if not heap:
            return n
        heapify(heap)
        after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
        while heap:
            _, i, pair = heappop(heap)
            j = after[i]
            if j >= n or symbols[i] != pair[0] or symbols[j] != pair[1]:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = pair[0] + pair[1], None
            left -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(p := (symbols[i], symbols[k]))) is not None:
                    heappush(heap, (r, i, p))
            if (h := before[i]) >= 0 and (r := rank(p := (symbols[h], symbols[i]))) is not None:
                heappush(heap, (r, h, p))
        return left

    def count(self, texts: list[str]) -> list[int]:
        cut, totals = [], []
        for t in texts:
            parts = self.special.split(t) if self.special else [t]
            totals.append(len(parts) - 1)
            cut.append([p for part in parts for p in (cutter(part) or FULL_PRETOKEN).findall(part)])
        get = self.known.want(set().union(*cut))
        return [n + sum(map(get, c)) for n, c in zip(totals, cut, strict=True)]


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Per row: its id, bytes, tokens, and whether the tokens exceed ``limit``."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = spec.value
        counter = per_worker(("counter", hash(text)), lambda: Counter(text))
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = [c for a, b in blocks(texts) for c in counter.count(texts[a:b])]
            yield pa.record_batch(
                [batch.column(0).cast(pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, SCHEMA.replace("doc_id", id_col, 1))
