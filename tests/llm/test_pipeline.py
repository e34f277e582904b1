from collections import defaultdict

import corpus_pipeline
from logmill.llm import quality, secret_scan

from .test_decontam import brute as brute_leaks
from .test_ngram_join import brute as brute_components
from .test_rules import brute_secrets
from .test_tokens import crc, ids_of


def plain_stages(docs, items):
    """Kept (doc_id, text) after each of the first four stages, by the plain versions."""
    judged = [(d, quality.Judged(t or "")) for d, t in docs]
    out = [[(d, j.cleaned) for d, j in judged if j.kept]]
    groups = {d: c for d, _, c in brute_components(out[-1])}
    out.append([(d, t) for d, t in out[-1] if groups[d] == d])
    leaked = {d for d, _ in brute_leaks(out[-1], items)}
    out.append([(d, t) for d, t in out[-1] if d not in leaked])
    masked = []
    for d, t in out[-1]:
        spans = [tuple(map(int, s.split(":")[1:])) for s in brute_secrets(t)[-1].split(",") if s]
        masked.append((d, secret_scan.masked(t, spans, "[secret]")))
    return [*out, masked]


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = plain_stages([(r["doc_id"], r["text"]) for r in docs.collect()], items)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    columns, now = docs.columns, docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, now, sf).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        rows = now.collect()
        assert now.columns == columns
        assert sorted((r["doc_id"], r["text"]) for r in rows) == sorted(want[k])
        assert all(r["n_chars"] == len(r["text"]) for r in rows)
    pieces = defaultdict(list)
    for r in corpus_pipeline.run(spark, sf).collect():
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == {d for d, _ in want[-1]}
    for d, t in want[-1]:
        ids, at = [*ids_of(t), 0], 0
        for r in sorted(pieces[d], key=lambda r: r["start"]):
            assert (r["start"], r["ids_crc32"]) == (at, crc(ids[at : at + r["length"]]))
            at += r["length"]
        assert at == len(ids)


def test_clean_documents_stay(spark):
    good = [(i, " ".join(f"Sentence {i} number {k} says thing {i * k}." for k in range(30)), "en", "s", 1) for i in range(1, 6)]
    now = spark.createDataFrame([*good, (7, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, "/root/testdata/sf0.001")
    assert sorted(r["doc_id"] for r in now.collect()) == [1, 2, 3, 4, 5]
