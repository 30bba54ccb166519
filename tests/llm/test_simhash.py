import random

import numpy as np
import pyarrow as pa  # noqa: F401
import xxhash
from pyspark.sql import functions as F

from streamloom.llm import simhash
from streamloom.llm.components import components

SCHEMA = "doc_id long, text string"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(ids, fps):
    label = {i: i for i in ids}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = root(ids[a]), root(ids[b])
                label[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_fingerprints_match_the_definition_and_sparks_hash(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").limit(60).collect()
    for r in rows:
        assert simhash.fingerprint(r["text"]) == plain_fingerprint(r["text"])
    assert simhash.fingerprint("One Two") == spark.sql("select xxhash64('one two') h").first()["h"] % 2**64
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    long = "some words go round and round again " * 900_000
    assert simhash.fingerprint(long[: 9 << 20]) == simhash.fingerprint(" ".join(long[: 9 << 20].split()))


def test_word_pieces_keep_words_whole():
    data = b" ab  cde f" * 50 + b"ghi"
    for size in (1, 3, 7, 1000):
        assert [w for p in simhash.word_pieces(data, size) for w in p] == data.split()


def test_hierarchy_finds_every_link():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(12)])
    near = np.unique(np.concatenate([near, rng.integers(0, 64, 50, dtype=np.uint64)]))
    order = near[np.argsort(simhash.gray_rank(near))]
    found = {(int(order[i]), int(order[j])) for a, b in simhash.links(order) for i, j in zip(a, b)}
    expect = {(int(order[i]), int(order[j])) for i in range(len(order)) for j in range(i + 1, len(order)) if (int(order[i]) ^ int(order[j])).bit_count() <= 3}
    assert found == expect


def test_query_equals_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    rng, extra = random.Random(5), []
    for n, r in enumerate(rng.sample(rows, 60)):
        words = r["text"].split()
        for m in range(3):
            words[rng.randrange(len(words))] = f"w{n}{m}"
            extra.append((10_000 + 10 * n + m, " ".join(words)))
    every = [(r["doc_id"], r["text"]) for r in rows] + extra
    got = {r["doc_id"]: r for r in simhash.near_duplicates(spark.createDataFrame(every, SCHEMA)).collect()}
    fps = [plain_fingerprint(t) for _, t in every]
    expect = plain_components([i for i, _ in every], fps)
    assert {i: r["component_id"] for i, r in got.items()} == expect
    assert {i: r["fp"] % 2**64 for i, r in got.items()} == dict(zip([i for i, _ in every], fps))
    assert len(set(expect.values())) < len(every) - 50


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 300)] + [(7, 7), (61, 60)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(62)} | {100 + i: 100 for i in range(300)}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_odd_rows(spark):
    rows = [(5, None), (3, ""), (9, " "), (1, "one"), (2, "one"), (2, "one"), (None, "two words"), (8, "y " * 100_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", component_id string")
    got = simhash.near_duplicates(df)
    assert sorted(r["component_id"] for r in got.where("doc_id in (3, 5, 9)").collect()) == [3, 3, 3]
    assert [r["component_id"] for r in got.where("doc_id = 2").collect()] == [1, 1]
    assert got.where("doc_id is null").first()["component_id"] is None and got.count() == len(rows)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.where(F.col("doc_id").isNotNull()).collect()) == [1, 3, 8]
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_components_of_random_graphs_by_either_join_and_few_tasks(spark, monkeypatch):
    draw = random.Random(5)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 1000 + i) for i in range(0, 40, 7)]
    label = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame(edges, "u long, v long")
    for most in (0, 100_000):
        monkeypatch.setattr("streamloom.llm.components.BROADCAST_EDGES", most)
        got = components(df).collect()
        assert {r["node"]: r["component"] for r in got} == label and len(got) == len(label)
    # edges that are stars already take no round
    rounds = []
    monkeypatch.setattr("streamloom.llm.components._with_least", lambda *a: rounds.append(a))
    stars = [(r["node"], r["component"]) for r in got]
    again = components(spark.createDataFrame(stars * 2, "u long, v long")).collect()
    assert {r["node"]: r["component"] for r in again} == label and not rounds
