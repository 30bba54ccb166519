"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A source's target is its weight's share of the words to take, stopped at a number of passes over the source, the excess
going to the others by weight. A source is cut into blocks of documents by a hash of the id. Whole passes take every
block; the rest of the target takes the first blocks of a seeded permutation, and of the block at the boundary the
documents that fit what is left. So each source has an exact quota of block draws. A binary tree over the output shards splits
those quotas: at each node the left half's draws by source follow the multivariate hypergeometric law, seeded by the
node, so every shard has an exact count of blocks from each source. The shards then take disjoint consecutive runs of
each source's permuted draws and are shuffled locally.

A source's draws are made in a task of their own, from at most GRID blocks. The driver sees a row for each source.

Defined cases: a null or blank text has size 0 and is taken as often as its block; a null source is a source of its own,
the last in order; rows of a repeated or null id are drawn together, but where they are more than one in SHARE of their
source's words, each by itself; an empty table gives an empty result;
plan() replaces columns that clash with its own, mix() only mix_shard; all others are carried along, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, number_within, without

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
GRID = 1 << 16
BROADCAST_ROWS = 200_000
SHARE = 256
#: Documents of a boundary block that are searched exactly, and the words that they may have together.
FINE, FINE_WORDS = 64, 1 << 22


def targets(sizes: list[int], weights: list[float], share: float, cap: float) -> list[float]:
    """Words to take of each source: share of all words by weight, none above cap times its size."""
    out, open_ = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    left = share * sum(sizes)
    while open_:
        per = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if per * weights[i] > cap * sizes[i]]
        if not full:
            for i in open_:
                out[i] = per * weights[i]
            break
        for i in full:
            out[i] = float(cap * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def split_tree(quotas: list[int], n_shards: int, seed: int) -> np.ndarray:
    """Draws of each source for each shard, shape (n_shards, sources); columns sum to the quotas."""
    out = np.zeros((n_shards, len(quotas)), dtype=np.int64)
    nodes = [(0, n_shards, np.array(quotas, dtype=np.int64))]
    while nodes:
        low, high, have = nodes.pop()
        if high - low == 1:
            out[low] = have
            continue
        mid, total = (low + high) // 2, int(have.sum())
        n_left = total * (mid - low) // (high - low)
        rng = np.random.default_rng([seed, low, high])
        left = rng.multivariate_hypergeometric(have, n_left, method="marginals") if total else have
        nodes += [(low, mid, left), (mid, high, have - left)]
    return out


def _join_small(df: DataFrame, small: DataFrame, n_rows: int, *on: str) -> DataFrame:
    """Join to a table whose rows have been counted: broadcast when few, a sort-merge join (which splits skew) beyond."""
    return df.join(F.broadcast(small) if n_rows <= BROADCAST_ROWS else small.hint("merge"), list(on), "left")


def nearest_subset(sizes: list[int], goal: float) -> list[int]:
    """Places of sizes whose sum is nearest to goal: the sums within reach as bits of a number, one number a prefix."""
    reach = [1]
    for n in sizes:
        reach.append(reach[-1] | reach[-1] << n)
    low = (reach[-1] & ((1 << int(goal) + 1) - 1)).bit_length() - 1
    above = reach[-1] >> int(goal) + 1
    high = int(goal) + (above & -above).bit_length() if above else None
    at, out = low if high is None or goal - low <= high - goal else high, []
    for i in range(len(sizes) - 1, -1, -1):
        if not reach[i] >> at & 1:
            out.append(i)
            at -= sizes[i]
    return out[::-1]


def _fitting(docs: pd.DataFrame) -> pd.DataFrame:
    """The documents of a boundary block that bring its sum nearest to what is left of the target: the larger ones in hash order while they fit, up to FINE of the smallest by exact search."""
    rest, own = docs["_rest"].iloc[0], sorted(zip(docs["size"].astype(int), docs["_h"].astype(int)))
    small = 0
    while small < min(FINE, len(own)) and sum(n for n, _ in own[: small + 1]) <= FINE_WORDS:
        small += 1
    fit = []
    for h, n in sorted((h, n) for n, h in own[small:]):
        if n <= rest:
            fit.append(h)
            rest -= n
    fit += [own[i][1] for i in nearest_subset([n for n, _ in own[:small]], rest)]
    return pd.DataFrame({"_s": [docs["_s"].iloc[0]], "_block": [docs["_block"].iloc[0]], "_fit": [fit]})


def draws_of(blocks: dict[int, int], number: int, size: int, target: float, cap: int, seed: int) -> tuple[dict[int, list[int]], tuple[int, float] | None]:
    """A source's draws: block -> its places in the order of draws; and the boundary block with what is left for it."""
    own = sorted(blocks)
    order = [own[j] for j in np.random.default_rng([seed, number]).permutation(len(own))]
    whole = min(cap, int(target // size)) if size else 0
    places: dict[int, list[int]] = {b: [p * len(order) + j for p in range(whole)] for j, b in enumerate(order)}
    at, rest, edge = whole * len(order), target - whole * size, None
    for b in order if size and whole < cap else []:
        places[b].append(at)
        at += 1
        if blocks[b] > rest:
            edge = (b, float(rest))
            break
        rest -= blocks[b]
    return {b: p for b, p in places.items() if p}, edge


def _told_apart(keyed: DataFrame, narrow: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with an _h of its own for each row of a source's repeated (or null) ids, where these are more than one in SHARE of its words: by the text, and equal rows by their number, as they can stand for each other."""
    total = narrow.groupBy("_s").agg(F.sum("size").alias("_all"))
    repeated = narrow.groupBy("_s", "_h").agg(F.count("*").alias("_rows"), F.sum("size").alias("_words")).where("_rows > 1")
    crowds = materialise(repeated.join(total, "_s").where(F.col("_words") > F.col("_all") / SHARE).select("_s", "_h", F.lit(True).alias("_crowd")), "mix-crowds")
    n = crowds.count()  # fewer than SHARE a source
    if not n:
        return keyed, narrow
    columns = ["_doc", "size", "_h", "_s"]
    own = _join_small(keyed, crowds, n, "_s", "_h").where("_crowd").select("_doc", "size", F.xxhash64("_h", "_doc.text").alias("_h"), "_s")
    own = number_within(own, ["_s", "_h"], "mix-repeated").withColumn("_h", F.xxhash64("_h", "_nth")).select(*columns)
    grid = F.pmod(F.col("_h"), F.lit(GRID)).cast("int")
    rest = lambda df: _join_small(df, crowds, n, "_s", "_h").where("_crowd is null").select(*df.columns)
    own = own.withColumn("_grid", grid)
    return rest(keyed).select(*columns, "_grid").unionByName(own), rest(narrow).unionByName(own.select("size", "_h", "_s", "_grid"))


def _planned(docs: DataFrame, n_shards: int, share: float, cap: int, seed: int, docs_per_block: int) -> DataFrame:
    """(_doc, _h, size, source_size, target, copies) of every row; _doc holds its columns."""
    spark = docs.sparkSession
    keyed = docs.select(
        F.struct("*").alias("_doc"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col("doc_id"), F.lit(seed)).alias("_h"),
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("_s"),
    ).withColumn("_grid", F.pmod(F.col("_h"), F.lit(GRID)).cast("int"))
    narrow = materialise(keyed.select("size", "_h", "_s", "_grid"), "mix-sizes")
    keyed, narrow = _told_apart(keyed, narrow)
    sources = narrow.groupBy("_s").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    sources.sort(key=lambda r: (r["_s"] == "n", r["_s"]))
    weights = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sources))]
    goal = targets([r["size"] for r in sources], weights, share, cap)
    rows = [(r["_s"], i, r["size"], float(t), int(min(GRID, max(1, -(-r["n"] // docs_per_block))))) for i, (r, t) in enumerate(zip(sources, goal))]
    about = spark.createDataFrame(rows, "_s string, _number int, source_size long, target double, _n int")
    block = F.floor(F.col("_grid") * F.col("_n") / GRID).cast("int")
    with_block = lambda df: _join_small(df, about, len(rows), "_s").withColumn("_block", block)

    def draw(of: pd.DataFrame) -> pd.DataFrame:
        first = of.iloc[0]
        places, edge = draws_of(dict(zip(of["_block"].tolist(), of["size"].tolist())), int(first["_number"]), int(first["source_size"]), float(first["target"]), cap, seed)
        rest = [edge[1] if edge and edge[0] == b else None for b in places]
        return pd.DataFrame({"_s": [first["_s"]] * len(places), "_block": list(places), "_places": list(places.values()), "_rest": pd.array(rest, dtype="Float64")})

    sized = with_block(narrow).groupBy("_s", "_block", "_number", "source_size", "target").agg(F.sum("size").alias("size"))
    drawn = materialise(sized.groupBy("_s").applyInPandas(draw, "_s string, _block int, _places array<long>, _rest double"), "mix-draws")
    quota = {r["_s"]: r["n"] for r in drawn.groupBy("_s").agg(F.sum(F.size("_places")).alias("n")).collect()}
    parts = split_tree([quota.get(r["_s"], 0) for r in sources], n_shards, seed).cumsum(0)
    # a source's draws before the end of each shard
    ends = spark.createDataFrame([(r["_s"], parts[:, i].tolist()) for i, r in enumerate(sources)], "_s string, _ends array<long>")
    shards = F.transform("_places", lambda k: F.size(F.filter("_ends", lambda e: e <= k)))
    edge = drawn.where("_rest is not null").select("_s", "_block", "_rest")
    inside = _join_small(with_block(narrow), edge, len(rows), "_s", "_block").where("_rest is not null").groupBy("_s", "_block", "_rest", "_h").agg(F.sum("size").alias("size"))
    fits = inside.groupBy("_s").applyInPandas(_fitting, "_s string, _block int, _fit array<long>")
    chosen = _join_small(drawn, ends, len(rows), "_s").select("_s", "_block", shards.alias("_shards"), "_rest").join(fits, ["_s", "_block"], "left")
    # a boundary block without documents that fit takes none of them
    chosen = materialise(chosen.withColumn("_fit", F.when(F.col("_rest").isNotNull(), F.coalesce("_fit", F.array().cast("array<long>")))).drop("_rest"), "mix-chosen")
    some = F.coalesce(F.col("_shards"), F.array().cast("array<int>"))
    copies = F.when(~F.array_contains("_fit", F.col("_h")), F.slice(some, F.lit(1), F.size(some) - 1)).otherwise(some)
    return _join_small(with_block(keyed), chosen, chosen.count(), "_s", "_block").select("_doc", "_h", "size", "source_size", "target", copies.alias("copies"))


def plan(docs: DataFrame, n_shards: int = 16, share: float = 1.5, cap: int = 2, seed: int = 9, docs_per_block: int = 64) -> DataFrame:
    """docs with size, source_size, target, copies (array of the shards that take the document, one entry a copy)."""
    kept = without(docs, "size", "source_size", "target", "copies")
    return _planned(kept, n_shards, share, cap, seed, docs_per_block).select("_doc.*", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, n_shards: int = 16, share: float = 1.5, cap: int = 2, seed: int = 9, docs_per_block: int = 64, shard_column: str | None = "mix_shard") -> DataFrame:
    """The mixed table: each document as often as its source's quota takes it, dealt by shard and shuffled inside it. shard_column names the shard in the result; None leaves it out and the documents' own columns as they are."""
    planned = _planned(without(docs, shard_column) if shard_column else docs, n_shards, share, cap, seed, docs_per_block)
    dealt = planned.select("_doc", "_h", F.posexplode("copies").alias("_copy", "_shard"))
    spread = dealt.withColumn("_order", F.xxhash64("_h", "_copy", "_shard"))
    ordered = spread.repartition("_shard", F.pmod("_order", F.lit(8))).sortWithinPartitions("_shard", "_order")
    return ordered.select("_doc.*", *([F.col("_shard").alias(shard_column)] if shard_column else []))
