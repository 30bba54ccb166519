import random
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from streamloom.llm import bytepair


def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module", params=["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def pairs(request):
    return bytepair.BytePairs(bytepair.read_ranks(public_tokenizers.path(request.param)))


def test_neighbours_agree_where_the_merges_leave_them(pairs):
    rng = random.Random(3)
    ids = sorted(pairs.tokens)
    for k in range(6000):
        a, b = (rng.choice(ids[: 1000 if k % 2 else None]) for _ in range(2))
        x, y = pairs.tokens[a], pairs.tokens[b]
        assert pairs.agree(a, b) == (pairs.merged(x + y) == [x, y])


def test_any_bytes_as_the_merges_have_them(pairs):
    rng = random.Random(4)
    for alphabet in (b"ab", b"aab ", b"the ing", b"0123", "éàü漢".encode(), bytes(range(256))):
        for n in (1, 2, 7, 40, 90):
            data = bytes(rng.choice(alphabet) for _ in range(n))
            assert [pairs.tokens[i] for i in pairs.encode(data)] == pairs.merged(data)


def test_a_long_match_takes_linear_time(pairs):
    data = b"abcab" * 60_000
    ids = pairs.encode(data)
    assert pairs.decode(ids) == data
    assert all(pairs.agree(a, b) for a, b in set(zip(ids, ids[1:])))


def test_a_vocabulary_without_a_byte_is_refused():
    with pytest.raises(ValueError):
        bytepair.BytePairs({b"a": 0})


def test_every_text_as_the_library_encodes_it(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    own = library(bytepair.read_ranks(bytepair.default_vocabulary()))
    got = {r["doc_id"]: r for r in bytepair.digest(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = own.encode_ordinary(r["text"] or "")
        sha = sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert tuple(got[r["doc_id"]]) == (r["doc_id"], len(ids), sha, sha256((r["text"] or "").encode()).hexdigest())


def test_odd_rows(spark, monkeypatch):
    texts = [None, "", " ", "\n\n  x", "it's we'll <|endoftext|>", "á漢字 😀 b", "z" * 50_000, "the cat " * 20_000, "the cat " * 20_000, "\0﻿"]
    rows = [(k if k % 4 else None, t, b"old", "kept") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, IDS binary, Decoded string")
    monkeypatch.setattr(bytepair, "SPLIT_AT_ONCE", 1000)
    back = bytepair.decode(bytepair.encode(docs))
    assert back.columns == ["doc_id", "text", "ids", "decoded"]
    own = library(bytepair.read_ranks(bytepair.default_vocabulary()))
    for r in back.collect():
        assert bytes(r["ids"]) == np.array(own.encode_ordinary(r["text"] or ""), dtype="<u4").tobytes()
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bytepair.digest(docs).where(F.col("n_tokens") == 0).count() == 2
    assert bytepair.digest(docs.where("false")).count() == 0
    # split in passing or at once
    encoder = bytepair.encoder(bytepair.default_vocabulary(), bytepair.default_pattern())
    long = "the cat " * 3000 + "漢" * 3000
    assert encoder.text(long) == np.array(own.encode_ordinary(long), dtype="<u4").tobytes()
