import os
import random
import zlib

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from streamloom.llm import huffman, tokens

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def tokenizer():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def expect(rows, tokenizer):
    out, start = [], 0
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), min_size=1, max_size=80), st.integers(7, 16))
def test_lengths_are_a_full_code(counts, most):
    lengths = huffman.code_lengths(counts, most)
    used = lengths[lengths > 0].astype(float)
    assert ((lengths > 0) == (np.array(counts) > 0)).all() and (not len(used) or used.max() <= most)
    assert len(used) < 2 or (2.0**-used).sum() == 1.0


def test_unlimited_lengths_cost_as_much_as_plain_huffman():
    import heapq

    counts = [2**i for i in range(12)] + [5, 5, 9]
    heap, cost = sorted(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        cost += x
        heapq.heappush(heap, x)
    assert int((huffman.code_lengths(counts, 16) * np.array(counts)).sum()) == cost


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=3000))
def test_blocks_decode(ids):
    ids = np.array(ids, dtype=np.int64)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=301))
    payload, checkpoints = huffman.encode(ids, lengths, huffman.canonical_codes(lengths))
    assert (huffman.Decoder(lengths).decode(payload, checkpoints, len(ids)) == ids).all()


def ids_of(texts):
    own = tokens.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    return [np.frombuffer(x, dtype="<u2").tolist() for x in own.texts(texts)]


def test_parts_give_the_tokenizers_ids(tokenizer):
    texts = ["I'll don't  go\n\n there \t x²½ 12 éèü ñ", "a\x1cb\x85c\xa0d", "日本語 text…", "it<|endoftext|>ends", " lead", "trail  ", "!!$$%% ___ __a_b", "\r\n\r\n", "ǅ ŉ ª º", "", "'s 'S ''s x'", "'", "'llama we're", "a\0b"]
    assert ids_of(texts) == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "'", "s", "re", "ll", "v", "e", "é", "12", "²", "!", "-'", "word"]), max_size=12).map("".join), max_size=5))
def test_any_plain_texts_give_the_tokenizers_ids(tokenizer, texts):
    assert ids_of(texts) == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_texts_are_cut_where_parts_begin(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "CHARS_AT_ONCE", 64)
    texts = ["some  words\n and 'more' words " * 9, "x" * 200, "short one", "tail " * 20]
    assert ids_of(texts) == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_whole_table(spark, small, tokenizer):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    for options in ({}, {"block_ids": 700}):
        got = sorted(tuple(r) for r in tokens.round_trip(docs.repartition(5), **options).collect())
        assert got == expect(rows, tokenizer)


def test_files_are_in_order(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    path = tokens.write(docs, f"file://{tmp_path}/ids", block_ids=500)
    files = sorted(p for p in os.listdir(f"{tmp_path}/ids/blocks") if p.startswith("part-"))
    starts = [r["start"] for f in files for r in spark.read.parquet(f"{path}/blocks/{f}").collect()]
    assert starts == sorted(starts) and len(starts) > 20


def test_odd_rows(spark, tokenizer):
    rows = [(None, "no id"), (1, None), (1, "one"), (1, "one"), (2, ""), (3, "long words " * 100_000), (9, "é" * 10)]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", ids int")
    got = sorted((tuple(r) for r in tokens.round_trip(df).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [i for i, _ in rows]
    assert sorted(r[2:] for r in got) == sorted(r[2:] for r in expect(rows, tokenizer))
    assert tokens.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_each_part_is_encoded_once_however_many_there_are(monkeypatch, tokenizer):
    path = public_tokenizers.path("byte_bpe_50k.json")
    draw = random.Random(3)
    words = ["".join(draw.choices("abcdeé0123'!", k=draw.randint(1, 9))) for _ in range(400)]
    batches = [[" ".join(draw.choices(words, k=draw.randint(0, 60))) for _ in range(5)] for _ in range(30)]
    for most, newest in ((2_000_000, 20), (150, 20)):
        monkeypatch.setattr(tokens, "CACHED_PARTS", most)
        monkeypatch.setattr(tokens, "NEWEST_PARTS", newest)
        own, asked = tokens._Encoder(path), []
        plain = own.part
        monkeypatch.setattr(own, "part", lambda p: asked.append(p) or plain(p))
        for texts in batches + batches:
            expect = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
            assert [np.frombuffer(x, dtype="<u2").tolist() for x in own.texts(texts)] == expect
        assert most == 150 or len(asked) == len(set(asked)) > 200
        assert len(own.keys) <= most
