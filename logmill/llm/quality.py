"""Line-first cleaning: quality rules are evaluated per line, failing lines are removed, and documents that lose
too much text are rejected.

Words are [^\\x20\\x09-\\x0D]+. Lines are what newlines part; lines without a word have no verdict. A line fails if
- symbols: it has over 0.3 characters of [#*$%&|<>] a word;
- shouting: it has over 0.3 times "!!" a word;
- bare: it has at most 3 words and ends in no punctuation;
- navigation: it has at most 12 words and two or more separators (|, », > between spaces);
- boilerplate: it has at most 20 words and one of BOILERPLATE;
- repeated: it equals an earlier line.
A document is rejected if it fails the base rules (under 50 words; over half its words in 3-word windows that
come twice or more) or if its failing lines hold over half of its words.

Each row is judged on its own, in one scan without a shuffle. Defined results: null text has no words and is
rejected; a null id stays null; repeated rows are all judged; empty tables give no rows; further columns are
ignored (clean_documents keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Ends of a line that count as punctuation, separators of menus, phrases of notices.
ENDS = ".!?:;,\"')]}…”’»"
SEPARATORS = (" | ", " » ", " > ")
BOILERPLATE = ("all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "click here", "accept cookies", "enable javascript", "subscribe to our newsletter", "read more", "sign up", "log in", "back to top", "share this", "add to cart",
               "todos los derechos reservados", "política de privacidad", "política de cookies", "haga clic aquí", "iniciar sesión", "alle rechte vorbehalten", "datenschutzerklärung", "hier klicken", "zum warenkorb", "tous droits réservés", "politique de confidentialité", "cliquez ici", "se connecter")
MIN_WORDS, MOST_REPEATED, MOST_LOST = 50, 0.5, 0.5
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that stand twice or more in the list."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    k = len(number)
    if k == n:
        return 0
    code = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]  # under 2^63 for 2 million different words
    if k >= 2_000_000:
        _, pair = np.unique(ids[:-2] * k + ids[1:-1], return_inverse=True)
        code = pair * k + ids[2:]
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    window = np.zeros(n, bool)
    window[order[1:][same]] = True
    window[order[:-1][same]] = True
    covered = window.copy()
    covered[1:] |= window[:-1]
    covered[2:] |= window[:-2]
    return int(covered.sum())


def failure(line: str, n_words: int) -> str | None:
    """Why a stripped line with words fails, if it does; repeats are not judged here."""
    if 10 * sum(map(line.count, SYMBOLS)) > 3 * n_words:
        return "symbols"
    if 10 * line.count("!!") > 3 * n_words:
        return "shouting"
    if n_words <= 3 and line[-1] not in ENDS:
        return "bare"
    if n_words <= 20:
        if n_words <= 12 and sum(map(line.count, SEPARATORS)) >= 2:
            return "navigation"
        low = line.translate(LOWER)
        if any(p in low for p in BOILERPLATE):
            return "boilerplate"
    return None


class Judged:
    """The figures of one text, its verdict, and what is left of it."""

    def __init__(self, text: str):
        words = text.encode().split()
        self.n_words = len(words)
        self.word_chars = len(text) - sum(map(text.count, SPACE))
        self.n_symbols = sum(map(text.count, SYMBOLS))
        self.n_dup_lines, lost, seen, stripped, left = 0, 0, set(), set(), []
        for line in text.split("\n"):
            core = line.strip(SPACE)
            if not core:
                left.append(line)
                continue
            if line in seen:
                self.n_dup_lines += 1
            seen.add(line)
            n = len(core.encode().split())
            if core in stripped or failure(core, n):
                lost += n
            else:
                left.append(line)
            stripped.add(core)
        self.n_repeat_words = repeated_words(words)
        self.base_failed = self.n_words < MIN_WORDS or self.n_repeat_words > MOST_REPEATED * self.n_words
        self.kept = not self.base_failed and lost <= MOST_LOST * self.n_words
        self.cleaned = "\n".join(left) if lost else text


def judge_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (SCHEMA) per document, and ``cleaned``: its text without failing lines."""
    names = [x.split()[0] for x in SCHEMA.split(", ")][1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch = whole.slice(a, 512)
                found = [Judged(t or "") for t in batch.column(1).to_pylist()]
                cols = [pa.array([getattr(j, n) for j in found], pa.bool_() if n in ("base_failed", "kept") else pa.int64()) for n in names]
                yield pa.record_batch([batch.column(0).cast(pa.int64()), *cols, pa.array([j.cleaned for j in found], pa.string())], names=[id_col, *names, "cleaned"])

    return docs.select(id_col, text_col).mapInArrow(run, SCHEMA.replace("doc_id", id_col, 1) + ", cleaned string")


def clean_documents(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The kept rows of ``docs`` with all their columns, their failing lines removed; ``length_col`` follows."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch = whole.slice(a, 512)
                texts = batch.column(at).to_pylist()
                found = [Judged(t or "") for t in texts]
                columns = list(batch.columns)
                columns[at] = pa.array([j.cleaned for j in found], batch.schema.field(at).type)
                if length_col in names:
                    k = names.index(length_col)
                    old = batch.column(k).to_pylist()
                    columns[k] = pa.array([o if j.cleaned == t else len(j.cleaned) for o, t, j in zip(old, texts, found, strict=True)], batch.schema.field(k).type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array([j.kept for j in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    word, core = r"[^\x20\x09-\x0D]+", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
    count = lambda s, of: " + ".join(f"(length({of}) - length(replace({of}, {quote(x)}, ''))) // {len(x)}" for x in s)
    phrases = " OR ".join(f"contains(low, {quote(p)})" for p in BOILERPLATE)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{word}') AS w FROM d),
line AS (SELECT r, i, ls[i] AS l, regexp_replace(ls[i], '{core}', '', 'g') AS c, len(regexp_extract_all(ls[i], '{word}')) AS n
         FROM (SELECT r, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT r, string_split(t, chr(10)) AS ls FROM d))),
judged AS (SELECT *, row_number() OVER (PARTITION BY r, l ORDER BY i) > 1 AS dup, row_number() OVER (PARTITION BY r, c ORDER BY i) > 1 AS again,
                  translate(c, '{upper}', '{upper.lower()}') AS low FROM line WHERE n > 0),
lines AS (SELECT r, count(*) FILTER (dup) AS n_dup_lines,
                 coalesce(sum(n) FILTER (again OR 10 * ({count(SYMBOLS, "c")}) > 3 * n OR 10 * ({count(["!!"], "c")}) > 3 * n
                   OR (n <= 3 AND NOT contains({quote(ENDS)}, right(c, 1))) OR (n <= 12 AND ({count(SEPARATORS, "c")}) >= 2)
                   OR (n <= 20 AND ({phrases}))), 0) AS lost FROM judged GROUP BY r),
tri AS (SELECT r, i, w[i:i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
many AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM tri) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM many, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
figures AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, ({count(SYMBOLS, "t")})::BIGINT AS n_symbols,
                   coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost
            FROM w LEFT JOIN lines USING (r) LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND 2 * lost <= n_words AS kept
FROM figures
"""
