import hashlib
import random
import re

import numpy as np
import pytest

from logmill.llm.substring_dedup import COVER, PERIOD, cover_positions, duplicated_words

from .common import empty, odd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    """rows: (id or None, text)."""
    low = lambda d: -(2**63) if d is None else d
    first = {}
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, low(d)), low(d))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < low(d):
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, window=50, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, duplicated_words(df, window=window, **kw).drop("kept").collect()), key=str)
    assert got == brute(rows, window)
    return sum(r[2] for r in got)


def test_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert check(spark, rows) > 0


def test_sql(spark, sf):
    from logmill.llm.substring_dedup import oracle

    from .test_rules import against_sql, with_texts

    passage = " ".join(f"p{i}" for i in range(70))
    docs = with_texts(spark, sf, [passage, f"a  b {passage}\nc", passage, "x " * 120, "x " * 90, "short"])
    against_sql(docs, duplicated_words(docs).drop("kept"), oracle())


def test_random_copies(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(4000)}"
    passages = [[word() for _ in range(rng.choice([49, 50, 51, 70, 130]))] for _ in range(6)]
    rows = []
    for d in range(60):
        text = []
        for _ in range(rng.randrange(5)):
            text += rng.choice(passages) if rng.random() < 0.6 else [word() for _ in range(rng.randrange(80))]
        if rng.random() < 0.3 and rows:
            text = rng.choice(rows)[1].split()
            if text and rng.random() < 0.7:
                text[rng.randrange(len(text))] = word()
        rows.append((d, " ".join(text)))
    rows += [(None, " ".join(passages[5])), (None, None), (3, rows[3][1]), (3, " ".join(passages[4] * 2)), (70, "x " * 500), (71, "x " * 300), (72, "\x85 \xa0 é " * 40)]
    assert check(spark, rows) > 500


def test_small_alphabet_and_window(spark):
    rng = random.Random(9)
    rows = [(d, " ".join(rng.choice("abc") for _ in range(rng.randrange(40)))) for d in range(80)]
    assert check(spark, rows, window=8, period=7, cover=(1, 2, 4), buckets=3) > 100


def test_odd_rows(spark):
    df = odd(spark)
    assert sorted(map(tuple, duplicated_words(df).drop("kept").collect()), key=str) == brute([(r["doc_id"], r["text"]) for r in df.collect()], 50)
    assert duplicated_words(empty(spark)).count() == 0


def test_rows_spread_over_buckets(spark):
    """Ids that are multiples of the number of buckets, and rows that all have none."""
    from logmill.llm.substring_dedup import ALL_NULL, bucket_column, doc_buckets, numbered

    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join([f"{d}-{i}" for i in range(20)] + passage[d % 7 :] + [f"{d}+{i}" for i in range(20)]) for d in range(64)]
    assert check(spark, [(16 * d, t) for d, t in enumerate(texts)], buckets=16) > 3000
    assert check(spark, [(None, t) for t in texts], buckets=16) == 0
    assert check(spark, [(None if d % 3 else d, t) for d, t in enumerate(texts)] + [(None, texts[0])] * 3, buckets=16) > 900
    df = spark.createDataFrame([(16 * d, t) for d, t in enumerate(texts)] + [(None, t) for t in texts], "doc_id long, text string")
    got = numbered(df, "doc_id", "text").select("doc_id", bucket_column("doc_id", 16).alias("b")).collect()
    assert len({r["b"] for r in got if r["doc_id"] >= ALL_NULL}) > 12 and len({r["b"] for r in got if r["doc_id"] < ALL_NULL}) > 12
    assert doc_buckets(np.array([r["doc_id"] for r in got]), 16).tolist() == [r["b"] for r in got]
    with pytest.raises(Exception, match="not supported"):
        duplicated_words(spark.createDataFrame([(-(2**63) + 5, "x")], "doc_id long, text string")).collect()


def test_cover():
    assert len(cover_positions(310)) == 60
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))
    with pytest.raises(ValueError):
        duplicated_words(None, cover=(1, 2))
