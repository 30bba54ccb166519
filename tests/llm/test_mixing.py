import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from streamloom.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def test_targets_stop_and_reshare():
    assert mixing.targets([100, 100], [5, 2], 1.5, 2) == [200.0, 100.0]
    got = mixing.targets([1000, 10, 10], [5, 2, 1], 1.5, 2)
    assert abs(sum(got) - 1530) < 1e-6 and got[1] == 20.0
    assert mixing.targets([0, 10], [5, 2], 1.5, 2) == [0.0, 15.0]
    assert mixing.targets([], [], 1.5, 2) == []


def test_split_tree_is_exact():
    quotas = [17, 0, 250, 3]
    parts = mixing.split_tree(quotas, 7, 3)
    assert parts.sum(0).tolist() == quotas and parts.min() >= 0
    assert parts.sum(1).max() - parts.sum(1).min() <= 3
    assert np.array_equal(parts, mixing.split_tree(quotas, 7, 3))


def test_nearest_subset():
    assert sum([5, 9, 14][i] for i in mixing.nearest_subset([5, 9, 14], 13.4)) == 14
    assert mixing.nearest_subset([100], 20.0) == [] and mixing.nearest_subset([], 7.0) == []
    assert mixing.nearest_subset([0, 30], 20.0) == [1]


def test_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = mixing.plan(docs).collect()
    assert len(rows) == docs.count()
    taken, size, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        assert len(r["copies"]) <= 2
        taken[r["source"]] += r["size"] * len(r["copies"])
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
    for s in size:
        assert abs(taken[s] - target[s]) <= 0.03 * target[s]
    names = sorted(size)
    expect = mixing.targets([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5, 2)
    assert [target[s] for s in names] == expect
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "mix_shard"]
    assert mixed.count() == sum(len(r["copies"]) for r in rows)
    again = {r["doc_id"]: r["copies"] for r in mixing.plan(docs.repartition(5)).collect()}
    assert again == {r["doc_id"]: r["copies"] for r in rows}


def plain_tree(quotas, low, high, seed):
    """Draws by shard, from the node of shards low to high down."""
    if high - low == 1:
        return {low: list(quotas)}
    mid, total = (low + high) // 2, int(sum(quotas))
    left = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(quotas, total * (mid - low) // (high - low), method="marginals") if total else quotas
    return plain_tree(left, low, mid, seed) | plain_tree([a - b for a, b in zip(quotas, left)], mid, high, seed)


def test_the_plan_equals_a_plain_version(spark, small):
    """Copies and shards of every row: blocks, draws, boundary and tree in lists."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    per_block, seed, n_shards = 4, 9, 5
    rows = [(r["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")), r["source"], r["h"]) for r in docs.withColumn("h", F.xxhash64("doc_id", F.lit(seed))).collect()]
    names = sorted({s for _, _, s, _ in rows})
    goal = mixing.targets([sum(n for _, n, s, _ in rows if s == name) for name in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5, 2)
    draws, short = [], set()
    for i, name in enumerate(names):
        own = [r for r in rows if r[2] == name]
        n_blocks = max(1, -(-len(own) // per_block))
        block = {r[0]: (r[3] % 65536) * n_blocks // 65536 for r in own}
        used = sorted(set(block.values()))
        order = [used[j] for j in np.random.default_rng([seed, i]).permutation(len(used))]
        words = lambda b: sum(r[1] for r in own if block[r[0]] == b)
        rest, taken = goal[i], []
        for b in order + order:
            taken.append([r[0] for r in own if block[r[0]] == b])
            if words(b) > rest:
                sums = {0: ()}  # every sum of the block's documents, the nearest to the rest wins
                for n, h, d in sorted((r[1], r[3], r[0]) for r in own if block[r[0]] == b):
                    for t in sorted(sums, reverse=True):
                        sums.setdefault(t + n, (*sums[t], d))
                assert len(taken[-1]) <= mixing.FINE
                best = min(abs(t - rest) for t in sums)
                short.add((name, len(taken) - 1, best))
                break
            rest -= words(b)
        draws.append(taken)
    tree = plain_tree([len(d) for d in draws], 0, n_shards, seed)
    expect, edges = defaultdict(list), {}
    for i, taken in enumerate(draws):
        k = 0
        for shard in range(n_shards):
            for _ in range(int(tree[shard][i])):
                edge = next((e for e in short if e[0] == names[i] and e[1] == k), None)
                for d in taken[k]:
                    if edge:
                        edges[d] = shard
                    else:
                        expect[d].append(shard)
                k += 1
    taken_words = defaultdict(int)
    for r in mixing.plan(docs, n_shards, docs_per_block=per_block).collect():
        taken_words[r["source"]] += r["size"] * len(r["copies"])
        assert r["copies"] in (expect[r["doc_id"]], expect[r["doc_id"]] + [edges.get(r["doc_id"])])
    # what a boundary block adds comes as near to the rest as any choice of its documents
    for i, name in enumerate(names):
        best = next((e[2] for e in short if e[0] == name), 0)
        assert abs(abs(taken_words[name] - goal[i]) - best) < 1e-6


def test_clashing_names_and_very_long_documents(spark):
    rows = [(i, "w " * (3 if i else 3_000_000), "a" if i % 2 else "b", 7, 8, 9, 10, 11, 12) for i in range(30)]
    docs = spark.createDataFrame(rows, SCHEMA + ", size int, _h int, _block int, _n int, _copy int, _s int")
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "mix_shard"]
    assert {tuple(r)[3:9] for r in mixed.collect()} == {(7, 8, 9, 10, 11, 12)}
    assert mixing.plan(docs).columns == ["doc_id", "text", "source", "_h", "_block", "_n", "_copy", "_s", "size", "source_size", "target", "copies"]


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "a b c", None), (3, "", "x"), (None, "d e", "x"), (4, "f " * 5000, "y"), (4, "f " * 5000, "y")]
    out = mixing.plan(spark.createDataFrame([(*r, 5) for r in rows], SCHEMA + ", Target int")).collect()
    assert len(out) == len(rows)
    assert {r["source"]: r["source_size"] for r in out} == {None: 3, "x": 2, "y": 10000}
    assert mixing.plan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sources_of_repeated_or_missing_ids_come_near_their_targets(spark):
    rows = [(5, "one two three four five six", "one id") for _ in range(400)] + [(None, f"w{i} x y z", "none") for i in range(400)] + [(i, "a b c " * (1 + i % 3), "many") for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    out = mixing.plan(docs, share=1.2).collect()
    assert len(out) == len(rows)
    taken, target = defaultdict(int), {}
    for r in out:
        taken[r["source"]] += r["size"] * len(r["copies"])
        target[r["source"]] = r["target"]
        assert len(r["copies"]) <= 2
    assert all(abs(taken[s] - target[s]) <= 6 for s in target)
    again = mixing.plan(docs.repartition(7), share=1.2).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
