import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from streamloom.llm import sharding

SCHEMA = "doc_id long, text string"


def check_law(rows, n_shards):
    load, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        assert r["size"] == len((r["text"] or "").encode()) + 8
        assert r["text_crc32"] == zlib.crc32((r["text"] or "").encode())
        assert 0 <= r["shard"] < n_shards and r["law"] == "bytes" and r["grown_shard"] is None
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return load


def test_whole_table_near_equal_and_copies_together(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = sharding.shard(docs, 6).collect()
    assert len(rows) == docs.count()
    load = check_law(rows, 6)
    mean = sum(load.values()) / 6
    assert max(load.values()) - min(load.values()) < 0.1 * mean
    where = defaultdict(set)
    for r in rows:
        where[r["text"]].add(r["shard"])
    assert all(len(s) == 1 for s in where.values())


def test_group_heavier_than_a_shard_is_split(spark):
    rows = [(i, "same text again " * 4) for i in range(600)] + [(1000 + i, f"text {i} " * 8) for i in range(600)]
    load = check_law(sharding.shard(spark.createDataFrame(rows, SCHEMA), 8).collect(), 8)
    assert max(load.values()) < 1.15 * sum(load.values()) / 8


def test_reruns_agree(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    key = lambda df: sorted((r["doc_id"], r["shard"], r["slot"]) for r in df.collect())
    assert key(sharding.shard(docs, 5)) == key(sharding.shard(docs.repartition(3), 5))


def test_the_result_equals_a_plain_version(spark, small):
    """Splitters, subdivision, packing and slots of every row in lists, from the rows' keys and chances."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    copies = spark.createDataFrame([(10_000 + i, "one text many times " * 30) for i in range(150)] + [(20_000 + i, f"tiny {i % 7}") for i in range(100)], SCHEMA)
    docs, n_shards, per_shard = docs.unionByName(copies), 6, 8
    keys = docs.select("doc_id", F.xxhash64("text").alias("h"), F.xxhash64("doc_id", F.lit("piece")).alias("k"), sharding.size_of(F.col("text")).alias("b"))
    rows = keys.withColumn("chance", sharding._chance(F.col("h"), F.col("k"))).collect()
    total, n = sum(r["b"] for r in rows), n_shards * per_shard
    ideal = total / n
    groups = defaultdict(int)
    for r in rows:
        groups[r["h"]] += r["b"]
    heavy = sorted(h for h, b in groups.items() if b > total / n_shards)
    sample = sorted(r["h"] for r in rows if r["chance"] < r["b"] * 16 / ideal)
    cuts = sorted({sample[len(sample) * i // n] for i in range(1, n)})

    def place(r):
        if r["h"] in heavy:
            return len(cuts) + 1 + heavy.index(r["h"]) * n + r["k"] % (1 << 64) % n
        return sum(c <= r["h"] for c in cuts)

    for again in range(1, 12):
        held = defaultdict(list)
        for r in rows:
            held[place(r)].append(r)
        over = {i for i, own in held.items() if sum(r["b"] for r in own) > 2 * ideal and len({r["h"] for r in own}) > 1}
        if not over:
            break
        inside = [r for i in over for r in held[i]]
        size = defaultdict(int)
        for r in inside:
            size[r["h"]] += r["b"]
        large = {h for h, b in size.items() if b > ideal / 4}
        more = sorted({r["h"] for r in inside if r["chance"] < r["b"] * 4 * again * 16 / ideal})[:: again * 16]
        cuts = sorted({*cuts, *more, *large, *[h + 1 for h in large], *[max(r["h"] for r in held[i]) for i in over]})
    load, shard_of = [0] * n_shards, {}
    for i in sorted(held, key=lambda i: (-sum(r["b"] for r in held[i]), i)):
        shard_of[i] = min(range(n_shards), key=lambda s: (load[s], s))
        load[shard_of[i]] += sum(r["b"] for r in held[i])
    got = {r["doc_id"]: r for r in sharding.shard(docs, n_shards, per_shard).collect()}
    place_of = {r["doc_id"]: place(r) for r in rows}
    assert all(g["shard"] == shard_of[place_of[i]] for i, g in got.items())
    for s in range(n_shards):
        order = sorted((r for r in rows if shard_of[place_of[r["doc_id"]]] == s), key=lambda r: (place_of[r["doc_id"]], r["h"], r["k"]))
        assert [got[r["doc_id"]]["slot"] for r in order] == list(range(len(order)))


def test_many_cells(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(10_000 + i, "one text many times " * 30) for i in range(150)], SCHEMA))
    rows = sharding.shard(docs, 6, 8, cell_bytes=2000).collect()
    check_law(rows, 6)
    one = {r["doc_id"]: r["shard"] for r in sharding.shard(docs, 6, 8).collect()}
    assert one == {r["doc_id"]: r["shard"] for r in rows}


def test_odd_rows(spark):
    rows = [(None, None), (1, None), (1, None), (2, ""), (3, "x" * 200_000), (3, "é")]
    df = spark.createDataFrame([(*r, 7, 1, 2, 3) for r in rows], SCHEMA + ", SHARD int, h int, start int, _doc int")
    out = sharding.shard(df, 3)
    assert [c.lower() for c in out.columns].count("shard") == 1
    check_law(out.collect(), 3)
    assert out.count() == len(rows)
    assert sharding.shard(spark.createDataFrame([], SCHEMA), 3).collect() == []


def test_copies_without_ids_or_of_one_id_are_split_too(spark):
    """3,000 copies of one text, most without an id or of one id, are most of the table: bytes stay near equal."""
    rows = [(None if i % 3 else 7, "the same text of some length " * 4, i) for i in range(3000)] + [(i, f"text {i} " * 12, i) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra int").repartition(5)
    out = sharding.shard(docs).collect()
    assert sorted(r["extra"] for r in out) == sorted(r[2] for r in rows)
    load, slots = {}, {}
    for r in out:
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(load) == 24 and max(load.values()) < 1.2 * min(load.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
