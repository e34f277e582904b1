import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from logmill.llm.common import tokenizer_path
from logmill.llm.packing import Packer, pack
from logmill.llm.token_counts import Counter, count_tokens
from logmill.llm.token_files import EliasFano, ShardReader, read_token_files, round_trip, write_token_files
from logmill.llm.tokens import Encoder, read_spec
from logmill.sources.storage import file_system

from .common import empty, odd

PATH = tokenizer_path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(PATH)
ENCODER, COUNTER = Encoder(read_spec(PATH)), Counter(read_spec(PATH))


def ids_of(text):
    return TOK.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def both(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs, odd(spark)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab Zé'sltr\n\t 1½²Ω漢​.,!<|endoftext|>😀"), max_size=40))
def test_ids_and_counts_are_those_of_the_library(text):
    ids = ids_of(text)
    assert np.frombuffer(ENCODER.encode([text])[0], ENCODER.dtype).tolist() == ids
    assert COUNTER.count([text]) == [len(ids)]


def test_small_caches_give_the_same():
    texts = [" ".join(random.Random(i).choices(["ab", "abc", "zq", "don't", "12", "é"], k=30)) for i in range(50)]
    small = Encoder(read_spec(PATH), most_pieces=3)
    for t in texts:
        assert np.frombuffer(small.encode([t])[0], small.dtype).tolist() == ids_of(t)


def test_counts(spark, sf):
    for docs in both(spark, sf):
        got = sorted(map(tuple, count_tokens(docs, PATH).collect()), key=str)
        want = sorted(((r["doc_id"], len((r["text"] or "").encode()), n := len(ids_of(r["text"])), n > 1024) for r in docs.collect()), key=str)
        assert got == want
    assert count_tokens(empty(spark), PATH).count() == 0


def test_pieces_cover_each_document_once(spark, sf):
    for docs in both(spark, sf):
        rows = pack(docs, PATH, block_chars=20_000).collect()
        want, got, sequences = defaultdict(list), defaultdict(list), defaultdict(list)
        for r in docs.collect():
            want[r["doc_id"]].append([*ids_of(r["text"]), 0])
        for r in rows:
            got[r["doc_id"]].append(r)
            sequences[r["sequence_id"]].append(r)
        assert set(got) == set(want)
        for key, texts in want.items():
            pieces = sorted(got[key], key=lambda r: r["start"])
            assert sum(r["length"] for r in pieces) == sum(map(len, texts))
            if len(texts) == 1:
                at = 0
                for r in pieces:
                    assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(texts[0]), crc(texts[0][at : at + r["length"]]))
                    at += r["length"]
        padding = 0
        for pieces in sequences.values():
            at = 0
            for r in sorted(pieces, key=lambda r: r["offset"]):
                assert r["offset"] == at and r["length"] > 0
                at += r["length"]
            assert at <= 1024
            padding += 0 if at & (at - 1) == 0 else 1024 - at
        assert padding <= 1024 * pack(docs, PATH).rdd.getNumPartitions()
    assert pack(empty(spark), PATH).count() == 0


def test_tiers_prefer_whole_pieces_and_fill_gaps():
    p = Packer((128, 256, 512, 1024))
    out = list(p.add([(0, 900), (1, 124), (2, 100), (3, 2048)]))
    assert [t for t, _ in out].count(1024) == 3
    assert (1024, [(0, 0, 900), (1, 0, 124)]) in out
    assert sum(n for _, s in p.finish() for _, _, n in s) == 100
    with pytest.raises(ValueError):
        Packer((100, 1024))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 10_000), max_size=400), st.integers(1, 50))
def test_elias_fano(steps, scale):
    values = np.cumsum(np.array(steps, np.int64)) * scale
    coded = EliasFano.from_bytes(EliasFano.encode(values).to_bytes())
    assert [coded.select(i) for i in range(len(values))] == values.tolist()
    assert coded.select_range(0, len(values)).tolist() == values.tolist()
    assert coded.select_range(len(values) // 3, len(values) // 2).tolist() == values[len(values) // 3 : len(values) // 2].tolist()


def test_elias_fano_is_small():
    coded = EliasFano.encode(np.cumsum(np.full(100_000, 700))).to_bytes()
    assert len(coded) * 8 / 100_000 < 13.5  # 2 + log2(700) and the sample, not 64


def test_token_files(spark, sf):
    for docs in both(spark, sf):
        got, start = sorted(map(tuple, round_trip(spark, docs, PATH).collect()), key=lambda r: r[1]), 0
        want = []
        for r in sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or "")):
            ids = [*ids_of(r["text"]), 2]
            want.append((r["doc_id"], start, len(ids), crc(ids)))
            start += len(ids)
        assert got == want
    assert round_trip(spark, empty(spark), PATH).count() == 0


def test_random_access(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 60")
    manifest = write_token_files(docs, PATH, f"file://{tmp_path}/t", partitions=2)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    seen = 0
    for row in manifest.collect():
        fs, path = file_system(row["path"])
        reader = ShardReader(fs.open_input_file(path))
        for i in range(reader.n):
            doc_id, ids = reader.document(i)
            assert ids.tolist() == [*ids_of(texts[doc_id]), 2]
            seen += 1
    assert seen == len(texts) == read_token_files(manifest).count()


def test_shards_roll_and_rows_without_id_spread(spark, tmp_path):
    texts = [f"text {i % 90:03} " * 20 for i in range(120)]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    manifest = write_token_files(docs, PATH, f"file://{tmp_path}/t", partitions=4, shard_tokens=1000)
    rows = sorted(manifest.collect(), key=lambda r: r["start"])
    assert len({r["path"].rsplit("/", 1)[1].split("-")[1] for r in rows}) > 2 and len(rows) > 4
    assert max(r["n_tokens"] for r in rows) < 1000 + 200
    got = [(r["start"], r["n_tokens"], r["ids_crc32"]) for r in sorted(read_token_files(manifest).collect(), key=lambda r: r["start"])]
    start, want = 0, []
    for t in sorted(texts):
        ids = [*ids_of(t), 2]
        want.append((start, len(ids), crc(ids)))
        start += len(ids)
    assert got == want


def test_step_groups_are_full(spark, sf):
    """Of a tier all groups but one hold as many sequences as make a step, over all tasks."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(7)
    got = pack(docs, PATH, step_tokens=8192).select("tier", "sequence_id", "step_group").distinct().collect()
    for tier in (128, 256, 512, 1024):
        groups = [r["step_group"] for r in got if r["tier"] == tier]
        sizes = sorted(map(groups.count, set(groups)))
        assert all(n == 8192 // tier for n in sizes[1:]) and (not sizes or sizes[0] <= 8192 // tier)
    assert len({r["sequence_id"] for r in got}) == len(got) and len({(r["tier"], r["step_group"]) for r in got}) == len({r["step_group"] for r in got}) > 20
