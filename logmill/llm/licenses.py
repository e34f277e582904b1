"""License scan: an exact set-similarity join of text blocks with license templates by containment. Blocks are the
lines, and across line ends the runs of words of a template's length, so hard-wrapped notices are found too.

Tokens are ordered by their frequency in all blocks of the corpus, the rarest first. A template is indexed
under its prefix, the rarest |T| - ceil(t |T|) + 1 tokens: a block that holds at least t of the template must
hold one of them (prefix filter). A block with too few tokens is skipped (length filter), and from the place
of the first common token in both orders the overlap still possible is bounded (positional filter). What
remains is verified, so exactly the blocks with containment >= t are found. Runs are only looked at for templates
that the whole text holds to t.

The templates are a parameter and the only thing that is sent to the executors; MOST_TEMPLATE_TOKENS bounds
them. The corpus is read twice (frequencies, join) and never shuffled; the frequencies that are gathered are
those of the templates' own tokens.

Defined results: null text counts as empty; a null id stays null; every row is judged on its own; empty
tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, slices

#: Labelled phrases of the base scan.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Opening or notice sentences of common licenses.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("gpl", "This work is licensed under the GNU General Public License."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("agpl", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)
THRESHOLD = 0.9
MOST_TEMPLATE_TOKENS = 1_000_000

#: ASCII letters and digits stay (A-Z in lower case), bytes of other characters too; the rest parts words.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def words(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


class TemplateIndex:
    """Templates as rising ranks of the global token order, and their prefixes."""

    def __init__(self, templates: tuple[tuple[str, str], ...], frequency: dict[bytes, int], threshold: float):
        sets = [(label, set(words(text.encode()))) for label, text in templates]
        self.span = [math.ceil(len(words(text.encode())) / threshold - 1e-9) for _, text in templates]
        order = sorted(set().union(*(s for _, s in sets)), key=lambda t: (frequency.get(t, 0), t))
        self.rank = {t: i for i, t in enumerate(order)}
        self.labels = [label for label, _ in sets]
        self.tokens = [sorted(self.rank[t] for t in s) for _, s in sets]
        self.need = [math.ceil(threshold * len(s) - 1e-9) for s in self.tokens]
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for i, s in enumerate(self.tokens):
            for at, r in enumerate(s[: len(s) - self.need[i] + 1]):
                self.postings.setdefault(order[r], []).append((i, at))
        self.prefix = frozenset(self.postings)

    def matches(self, block: list[bytes]) -> list[tuple[str, float]]:
        """(label, containment) of each template that the block's words hold to the threshold."""
        return [(self.labels[i], overlap / len(self.tokens[i])) for i, overlap in self.hits(block)]

    def hits(self, block: list[bytes]) -> list[tuple[int, int]]:
        """(template, number of its words in the block) of the same."""
        if self.prefix.isdisjoint(block):
            return []
        distinct = set(block)
        known = sorted(self.rank[t] for t in distinct if t in self.rank)
        place = {r: q for q, r in enumerate(known)}
        seen, found = set(), []
        for token in sorted(distinct & self.prefix, key=self.rank.__getitem__):
            for i, at in self.postings[token]:
                if i in seen:
                    continue
                seen.add(i)
                size, need = len(self.tokens[i]), self.need[i]
                if len(distinct) < need or min(size - at, len(known) - place[self.rank[token]]) < need:
                    continue
                overlap = sum(r in place for r in self.tokens[i])
                if overlap >= need:
                    found.append((i, overlap))
        return found

    def runs(self, block: list[bytes], i: int) -> Iterator[tuple[int, int, int]]:
        """(first, last, overlap): of each stretch of runs of span words that hold template i, the one with most of it."""
        own, span, need = set(self.tokens[i]), self.span[i], self.need[i]
        held: Counter = Counter()
        inside: deque[tuple[int, int]] = deque()
        best = None
        for at, word in enumerate(block):
            r = self.rank.get(word)
            if r not in own:
                continue
            inside.append((at, r))
            held[r] += 1
            while at - inside[0][0] >= span:
                _, gone = inside.popleft()
                held[gone] -= 1
                if not held[gone]:
                    del held[gone]
            if len(held) >= need:
                if best is not None and inside[0][0] > best[1]:
                    yield best
                    best = None
                if best is None or len(held) > best[2]:
                    best = (inside[0][0], at, len(held))
        if best is not None:
            yield best


def template_frequencies(docs: DataFrame, vocabulary: set[bytes], text_col: str = "text") -> dict[bytes, int]:
    """In how many blocks of the whole corpus each template token stands; a row a token comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in slices(batches):
            for text in byte_texts(batch.column(0)):
                for line in text.split(b"\n"):
                    total.update(vocabulary.intersection(words(line)))
        yield pa.record_batch([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["token", "n"])

    rows = docs.select(text_col).mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["token"]): r["n"] for r in rows}


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row (SCHEMA) and ``blocks``: the found blocks as (number of the first line, label, containment). score: the highest
    containment; 1 where a labelled phrase stands."""
    vocabulary = set(words(" ".join(t for _, t in templates).encode()))
    if not templates or len(vocabulary) > MOST_TEMPLATE_TOKENS:
        raise ValueError("templates are needed, of at most a million different tokens")
    frequency = template_frequencies(docs, vocabulary, text_col)
    probes = [(b" " + p.encode() + b" ", label) for p, label in phrases]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TemplateIndex(templates, frequency, threshold)
        for batch in slices(batches):
            cols: list[list] = [[] for _ in range(8)]
            for text in byte_texts(batch.column(1)):
                n, at, all_words, blocks, lines, held = 0, [], [], [], [], {}
                for number, line in enumerate(text.split(b"\n")):
                    block = words(line)
                    for i, overlap in index.hits(block):
                        blocks.append((number, index.labels[i], overlap / len(index.tokens[i])))
                        held[number, i] = overlap
                    all_words += block
                    lines += [number] * len(block)
                for i, _ in index.hits(all_words) if lines and lines[0] < lines[-1] else ():
                    for first, last, overlap in index.runs(all_words, i):
                        a, z = lines[first], lines[last]
                        if a < z and all(held.get((k, i), 0) < overlap for k in range(a, z + 1)):
                            blocks.append((a, index.labels[i], overlap / len(index.tokens[i])))
                n = len(all_words)
                joined, base, places = b" " + b" ".join(all_words) + b" ", set(), 0
                for probe, label in probes:
                    found, upto, place = joined.find(probe), 0, 0
                    while found >= 0:
                        place, upto = place + joined.count(b" ", upto, found), found
                        at.append(place)
                        base.add(label)
                        places += 1
                        found = joined.find(probe, found + 1)
                labels = base | {label for _, label, _ in blocks}
                score = 1.0 if base else max((s for _, _, s in blocks), default=0.0)
                row = (n, places, min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, blocks)
                for col, value in zip(cols, row, strict=True):
                    col.append(value)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("line", pa.int64()), ("label", pa.string()), ("containment", pa.float64())]))]
            cols[7] = [[{"line": a, "label": b, "containment": c} for a, b, c in row] for row in cols[7]]
            names = [x.split()[0] for x in SCHEMA.split(", ")][1:]
            yield pa.record_batch([batch.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=[id_col, *names, "blocks"])

    return docs.select(id_col, text_col).mapInArrow(run, SCHEMA.replace("doc_id", id_col, 1) + ", blocks array<struct<line: long, label: string, containment: double>>")


def _sql_list(items: list[str]) -> str:
    return "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]"


def oracle() -> str:
    """The same rows by comparing every line, and every run of a template's span of words, with every template."""
    sets = [(label, text, sorted(w.decode() for w in set(words(text.encode())))) for label, text in TEMPLATES]
    rows = ", ".join(f"({i}, '{label}', {_sql_list(s)}, {math.ceil(len(words(text.encode())) / THRESHOLD - 1e-9)}, {math.ceil(THRESHOLD * len(s) - 1e-9)})" for i, (label, text, s) in enumerate(sets))
    probes = ", ".join(f"('{label}', {_sql_list(p.split())})" for p, label in PHRASES)
    upper, word = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS t FROM documents),
w AS (SELECT doc_id, r, regexp_extract_all(t, '{word}') AS w FROM d),
probe(label, p) AS (VALUES {probes}),
place AS (SELECT r, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1:i + len(p)] = p)) AS pos FROM w, probe),
base AS (SELECT r, count(*) AS n, min(pos) AS a, max(pos) AS b FROM place GROUP BY r),
template(k, label, s, span, need) AS (VALUES {rows}),
line AS (SELECT r, list_distinct(regexp_extract_all(l, '{word}')) AS s FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d)),
whole AS (SELECT r, k, w, template.s FROM (SELECT r, w, list_distinct(w) AS u FROM w), template WHERE len(list_intersect(u, template.s)) >= need),
word AS (SELECT r, k, i, w[i] AS x FROM (SELECT r, k, w, s, unnest(range(1, len(w) + 1)) AS i FROM whole) WHERE list_contains(s, w[i])),
run AS (SELECT r, k, max(n) AS n FROM (SELECT a.r, a.k, a.i, count(DISTINCT b.x) AS n FROM word a JOIN template USING (k) JOIN word b ON b.r = a.r AND b.k = a.k AND b.i BETWEEN a.i - span + 1 AND a.i GROUP BY a.r, a.k, a.i) GROUP BY r, k),
found AS (SELECT r, label, len(list_intersect(line.s, template.s)) / len(template.s) AS c FROM line, template WHERE len(list_intersect(line.s, template.s)) >= need
          UNION ALL SELECT r, label, n / len(s) FROM run JOIN template USING (k) WHERE n >= need),
labelled AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM place UNION SELECT r, label FROM found) GROUP BY r),
labelled_base AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM place GROUP BY r),
best AS (SELECT r, max(c) AS c FROM found GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, b::BIGINT AS last_word,
       coalesce(lb.labels, '') AS base_labels, coalesce(l.labels, '') AS labels,
       CASE WHEN n > 0 THEN 1.0 ELSE coalesce(c, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN labelled l USING (r) LEFT JOIN labelled_base lb USING (r) LEFT JOIN best USING (r)
"""
