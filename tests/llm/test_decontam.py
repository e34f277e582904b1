import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from logmill.llm import decontam
from logmill.llm.decontam import common_length, find_leaks, masks, text_words, without_leaks

from .common import empty, odd


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 6), min_size=1, max_size=70), st.lists(st.integers(0, 6), max_size=90))
def test_common_length(a, b):
    assert common_length(masks(a), len(a), b) == lcs(a, b)


def brute(docs, items):
    """Every window against every item."""
    out = set()
    for item_id, text in items:
        item = text_words(text)
        if not item:
            continue
        half = 16
        while half < len(item):
            half *= 2
        tail = item[-max(1, -(-len(item) // 4)) :]
        for doc_id, body in docs:
            w = text_words(body)
            n_blocks = -(-len(w) // 16)
            for a in range(0, max(1, n_blocks - half // 16) if w else 0, half // 16):
                window = w[a * 16 : a * 16 + 2 * half]
                if len(set(item) & set(window)) < 0.2 * len(set(item)):
                    continue
                n = lcs(item, window)
                if n >= 0.8 * len(item) or n >= 0.6 * len(item) and lcs(tail, window) >= 0.75 * len(tail):
                    out.add((doc_id, item_id))
    return out


def test_table_matches_brute_force(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in find_leaks(docs, items).collect()}
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])


def test_planted_leaks_and_paraphrases(spark, sf):
    rng = random.Random(2)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    planted = []
    for k, (item_id, text) in enumerate(items):
        w = text.split()
        if k % 3 == 1:  # one word in eight changed
            for i in range(3, len(w), 8):
                w[i] = rng.choice(docs[k][1].split())
        if k % 3 == 2:
            w = [x.upper() + "," for x in w]
        body = docs[rng.randrange(len(docs))][1].split()
        cut = rng.randrange(len(body) + 1)
        planted.append((10_000 + k, " ".join(body[:cut] + w + body[cut:]), item_id))
    everything = docs + [(d, t) for d, t, _ in planted]
    df = spark.createDataFrame(everything, "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["item_id"]) for r in find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute(everything, items)
    missed = want - got
    assert not got - want, got - want
    assert not {(d, i) for d, _, i in planted} - got
    assert len(missed) <= 0.02 * len(want), missed


def test_recall_of_exact_passages(spark):
    """Every benchmark item that stands whole in a document is found."""
    sf = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in find_leaks(docs, items).collect()}
    norm = lambda t: b" " + b" ".join(text_words(t)) + b" "
    bodies = [(r["doc_id"], norm(r["text"])) for r in docs.collect()]
    want = {(d, r["item_id"]) for r in items.collect() for d, b in bodies if norm(r["text"]) in b}
    assert want and want <= got


def test_odd_rows(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma endoftext delta"), (None, None), (2, "")], "item_id long, text string")
    got = find_leaks(odd(spark), items).collect()
    assert [(r["doc_id"], r["item_id"], r["lcs"]) for r in got] == [(0, 1, 5)]
    assert find_leaks(empty(spark), items).count() == 0
    assert find_leaks(odd(spark), items.filter("false")).count() == 0
    kept = without_leaks(odd(spark), items)
    assert kept.columns == odd(spark).columns and kept.count() == odd(spark).count() - 1
    assert re.match(r"doc_id", find_leaks(odd(spark), items.filter("item_id = 2")).columns[0])
    assert decontam.RANK > 0


def test_no_accepted_window_is_lost(spark, sf):
    """Items of a larger benchmark, whole or with many words changed, at random places of long documents."""
    rng = random.Random(5)
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r["text"]]
    long = [t.split() for t in texts if len(t.split()) > 150]
    items = []
    for k in range(400):
        body = rng.choice(long)
        a = rng.randrange(len(body) - 60)
        items.append((k, " ".join(body[a : a + rng.randrange(15, 60)])))
    items.append((400, " ".join(w for w, _ in Counter(w for t in texts for w in t.lower().split()).most_common(20))))  # stop words
    docs, want = [(k, t) for k, t in enumerate(texts)], set()
    for k, (item_id, text) in enumerate(items * 3):
        w = text.split()
        for i in rng.sample(range(len(w)), len(w) * (0, 1, 3)[k // len(items)] // 8):
            w[i] = rng.choice(rng.choice(long))
        body = rng.choice(long)
        cut = rng.randrange(len(body))
        docs.append((100_000 + k, " ".join(body[:cut] + w + body[cut:])))
        item, words = decontam.Item(item_id, text_words(text)), text_words(docs[-1][1])
        half = item.blocks * decontam.BLOCK
        if any(item.check(words[a : a + 2 * half]) for a in range(0, len(words), half)[: max(1, -(-len(words) // half) - 1)]):
            want.add((docs[-1][0], item_id))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(want) > 900 and not want - {(r["doc_id"], r["item_id"]) for r in found}
    assert all(-1.001 <= r["cosine"] <= 1.001 for r in found)


def test_leaked_document_without_id_goes(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon")], "item_id long, text string")
    docs = spark.createDataFrame([(None, "so alpha beta gamma delta epsilon it is"), (1, "another text"), (2, "alpha beta gamma delta epsilon")], "doc_id long, text string")
    assert [r["doc_id"] for r in without_leaks(docs, items).collect()] == [1]


def test_index_entries_in_parts(monkeypatch):
    rng = random.Random(3)
    rows = [(i, " ".join(str(min(rng.randrange(40), rng.randrange(40))) for _ in range(rng.randrange(1, 40)))) for i in range(60)]
    known = decontam.Benchmark(rows)
    count = np.array([1000, *(rng.randrange(50) for _ in range(known.n - 1))])
    docs = [np.array([rng.randrange(known.n) for _ in range(rng.choice([0, 5, 60, 400]))], np.uint32) for _ in range(40)]
    docs += [np.array(known.items[i].ids, np.uint32) for i in range(0, 60, 7)]
    search = lambda: decontam.Searcher(rows, count, np.ones(known.n, np.float32), np.eye(known.n, dtype=np.float32)).search(docs)
    got = search()
    want = [{i for i, item in enumerate(known.items) for a in range(0, max(1, -(-len(d) // 16) - item.blocks) * 16 if len(d) else 0, item.blocks * 16) if item.check(d[a : a + 32 * item.blocks].tolist())} for d in docs]
    assert [{f[0] for f in found} for found in got] == want and sum(map(len, want)) > 9
    monkeypatch.setattr(decontam, "MOST_ENTRIES", 3)
    assert search() == got


def test_a_large_benchmark_is_searched_in_parts(spark, sf, monkeypatch):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    columns = ["doc_id", "item_id", "n_words", "lcs", "item_words", "answer"]
    whole = sorted(map(tuple, decontam.find_leaks(docs, items).select(*columns).collect()))
    monkeypatch.setattr(decontam, "MOST_ITEM_WORDS", 300)
    assert sorted(map(tuple, decontam.find_leaks(docs, items).select(*columns).collect())) == whole and whole
