"""Secret scan by a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived: what every match must contain.
Texts are taken in blocks; a block's posting lists (trigram -> documents) are built for the trigrams that the
queries name, on lower-cased bytes, and intersected and united as the queries say. Only candidates are matched
with the regex itself. Rules without a mandatory trigram match every text. The index lives as long as its
block, so memory is bounded, nothing is shuffled, and a lost executor costs its blocks only.

Defined results: null text counts as empty; a null id stays null; every row is scanned on its own; empty
tables give no rows; further columns are ignored. Places are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import product
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Kind, pattern, whether ASCII letters match in either case, group and least length of it.
BASE = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 12),
    ("access", r"AKIA[A-Z0-9]+", False, 0, 18),
    ("hex", r"[0-9a-f]+", False, 0, 16),
)
#: Well-known credential formats.
MORE = (
    ("github", r"gh[pousr]_[A-Za-z0-9]+", False, 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", False, 0, 15),
    ("google", r"AIza[0-9A-Za-z_-]+", False, 0, 39),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", False, 0, 0),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", False, 0, 0),
    ("stripe", r"[rs]k_(?:live|test)_[0-9a-zA-Z]+", False, 0, 24),
)
RULES = BASE + MORE

#: A query is True (no condition), a trigram, or ("all" | "any", queries).
Query = bool | bytes | tuple
MOST_STRINGS, WIDEST_CLASS = 64, 4


def _all(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("all", tuple(parts))


def _any(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("any", tuple(parts))


def _grams(strings: set[str]) -> Query:
    """What a text must contain that contains one of the strings."""
    return _any([_all([b[i : i + 3] for i in range(len(b) - 2)]) for b in (s.encode() for s in sorted(strings))])


def _class(items) -> set[str] | None:
    out: set[str] = set()
    for op, value in items:
        if op is C.LITERAL:
            out.add(chr(value).lower())
        elif op is C.RANGE and value[1] - value[0] < 2 * WIDEST_CLASS:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= WIDEST_CLASS else None


def _analyse(node) -> tuple[set[str] | None, Query]:
    """(all lower-cased strings that it can match, or None if too many; its query beyond these)."""
    exact: set[str] = {""}
    parts: list[Query] = []
    whole = True
    for op, value in node:
        own: set[str] | None = None
        query: Query = True
        if op is C.LITERAL:
            own = {chr(value).lower()}
        elif op is C.IN:
            own = _class(value)
        elif op is C.SUBPATTERN:
            own, query = _analyse(value[-1])
        elif op is C.BRANCH:
            options = [_analyse(x) for x in value[1]]
            if all(s is not None for s, _ in options):
                own = set().union(*(s for s, _ in options))
            else:
                query = _any([q if s is None else _grams(s) for s, q in options])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            least, most, sub = value
            inner, inner_query = _analyse(sub)
            if (least, most) in ((0, 1), (1, 1)) and inner is not None:
                own = inner | ({""} if least == 0 else set())
            elif least:
                query = inner_query if inner is None else _grams(inner)
        elif op is C.AT:
            own = {""}
        if own is not None and len(exact) * len(own) <= MOST_STRINGS:
            exact = {a + b for a, b in product(exact, own)}
            continue
        whole = False
        parts += [_grams(exact), query if own is None else True]
        exact = {""} if own is None else own
    if whole:
        return exact, True
    return None, _all([*parts, _grams(exact)])


def trigram_query(pattern: str) -> Query:
    exact, query = _analyse(_parser.parse(pattern))
    return _grams(exact) if exact is not None else query


def trigrams_in(query: Query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams_in, query[1]))


class TrigramIndex:
    """Posting lists of the wanted trigrams over one block of texts."""

    LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

    def __init__(self, wanted: set[bytes]):
        self.wanted = {int.from_bytes(t, "big"): t for t in wanted}
        self.table = np.zeros(1 << 24, np.bool_)
        self.table[list(self.wanted)] = True

    def postings(self, data: np.ndarray, offsets: np.ndarray, step: int = 1 << 22) -> dict[bytes, np.ndarray]:
        """data: the bytes of all texts in a row; offsets: where each begins, and the end."""
        found: list[np.ndarray] = []
        codes: list[np.ndarray] = []
        for a in range(int(offsets[0]), int(offsets[-1]) - 2, step):
            part = self.LOWER[data[a : min(a + step + 2, int(offsets[-1]))]].astype(np.int32)
            code = part[:-2] << 16 | part[1:-1] << 8 | part[2:]
            at = np.flatnonzero(self.table[code])
            found.append(at + a)
            codes.append(code[at])
        if not found:
            return {}
        at, code = np.concatenate(found), np.concatenate(codes)
        doc = np.searchsorted(offsets, at, side="right") - 1
        inside = at + 2 < offsets[doc + 1]
        code, doc = code[inside], doc[inside]
        return {self.wanted[int(c)]: np.unique(doc[code == c]) for c in np.unique(code)}

    def search(self, query: Query, postings: dict[bytes, np.ndarray], n: int) -> np.ndarray:
        if query is True:
            return np.arange(n)
        if isinstance(query, bytes):
            return postings.get(query, np.zeros(0, np.int64))
        lists = [self.search(q, postings, n) for q in query[1]]
        if query[0] == "any":
            return np.unique(np.concatenate(lists))
        out = min(lists, key=len)
        for x in lists:
            out = np.intersect1d(out, x)
        return out


class Scanner:
    """spans(column): for each text the (start, rule number, end) of its secrets, in order."""

    def __init__(self, rules=RULES):
        self.rules = [(kind, re.compile(pattern, re.ASCII | (re.IGNORECASE if either else 0)), group, least) for kind, pattern, either, group, least in rules]
        self.queries = [trigram_query(pattern) for _, pattern, *_ in rules]
        self.index = TrigramIndex(set().union(*map(trigrams_in, self.queries)))

    def spans(self, column: pa.Array) -> list[list[tuple[int, int, int]]]:
        column = column.cast(pa.large_string())
        if column.null_count:
            column = column.fill_null("")
        n = len(column)
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64, n + 1, 8 * column.offset) if n else np.zeros(1, np.int64)
        bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        postings = self.index.postings(bytes_, offsets)
        texts: dict[int, str] = {}
        for number, ((_, pattern, group, least), query) in enumerate(zip(self.rules, self.queries, strict=True)):
            for doc in self.index.search(query, postings, n).tolist():
                if (text := texts.get(doc)) is None:
                    text = texts[doc] = column[doc].as_py()
                for m in pattern.finditer(text):
                    if m.end(group) - m.start(group) >= least:
                        found[doc].append((m.start(), number, m.end()))
        for spans in found:
            spans.sort()
        return found


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES, n_base: int = len(BASE), block_rows: int = 512) -> DataFrame:
    """Per row: its id, a count per base kind, the digest of the base spans, and all spans as kind:start:end."""
    kinds = [r[0] for r in rules]
    counts = [f"n_{k}" for k in kinds[:n_base]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for whole in batches:
            for a in range(0, whole.num_rows, block_rows):
                batch = whole.slice(a, block_rows)
                cols: list[list] = [[] for _ in range(n_base + 2)]
                for spans in scanner.spans(batch.column(1)):
                    for k in range(n_base):
                        cols[k].append(sum(s[1] == k for s in spans))
                    base = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans if k < n_base)
                    cols[-2].append(hashlib.sha256(base.encode()).hexdigest())
                    cols[-1].append(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans))
                arrays = [pa.array(c, pa.int64() if i < n_base else pa.string()) for i, c in enumerate(cols)]
                yield pa.record_batch([batch.column(0).cast(pa.int64()), *arrays], names=[id_col, *counts, "base_sha256", "spans"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} long, {', '.join(f'{c} long' for c in counts)}, base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[int, int]], mask: str) -> str:
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join(out) + text[at:]


def mask_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mask: str = "[secret]", rules=RULES, block_rows: int = 512) -> DataFrame:
    """All rows and columns of ``docs``, with each secret in the text replaced by ``mask``; ``length_col`` follows."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for whole in batches:
            for a in range(0, whole.num_rows, block_rows):
                batch = whole.slice(a, block_rows)
                spans = scanner.spans(batch.column(at))
                if not any(spans):
                    yield batch
                    continue
                texts = batch.column(at).to_pylist()
                for i, found in enumerate(spans):
                    if found:
                        texts[i] = masked(texts[i], [(s[0], s[2]) for s in found], mask)
                columns = list(batch.columns)
                columns[at] = pa.array(texts, batch.schema.field(at).type)
                if length_col in names:
                    k = names.index(length_col)
                    old = batch.column(k).to_pylist()
                    columns[k] = pa.array([len(t) if f else o for t, f, o in zip(texts, spans, old, strict=True)], batch.schema.field(k).type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def _either_case(pattern: str) -> str:
    """The pattern with each letter outside of its classes and escapes as a class of both cases."""
    out, inside, at = "", False, 0
    while at < len(pattern):
        size = 4 if pattern.startswith("\\x", at) else 2 if pattern[at] == "\\" else 1
        part = pattern[at : at + size]
        inside = part == "[" or inside and part != "]"
        out += f"[{part.upper()}{part.lower()}]" if size == 1 and not inside and part.isalpha() else part
        at += size
    return out


def oracle() -> str:
    """The base and further rules on every text, without an index. What stands between a rule's matches tells where they are."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    ways = []
    for k, (kind, pattern, either, group, least) in enumerate(RULES):
        p = quote(_either_case(pattern) if either else pattern)
        ways.append(f"SELECT r, {k} AS k, '{kind}' AS kind, {least} AS least, regexp_split_to_array(t, {p}) AS gaps, regexp_extract_all(t, {p}) AS hits, regexp_extract_all(t, {p}, {group}) AS parts FROM d WHERE regexp_matches(t, {p})")
    kinds = ", ".join(f"count(*) FILTER (k = {k}) AS n_{RULES[k][0]}" for k in range(len(BASE)))
    counts = ", ".join(f"coalesce(n_{RULES[k][0]}, 0)::BIGINT AS n_{RULES[k][0]}" for k in range(len(BASE)))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(ways)}),
each AS (SELECT r, k, kind, least, parts[i] AS part, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS a, length(hits[i]) AS n
         FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM found)),
span AS (SELECT r, k, a, kind || ':' || a::BIGINT || ':' || (a + n)::BIGINT AS s FROM each WHERE length(part) >= least),
told AS (SELECT r, {kinds}, string_agg(s, ',' ORDER BY a, k) FILTER (k < {len(BASE)}) AS base, string_agg(s, ',' ORDER BY a, k) AS spans FROM span GROUP BY r)
SELECT doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN told USING (r)
"""
