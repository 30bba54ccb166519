"""Sharding by sampled splitters.

Records are ordered by (hash of text, hash of id). A size-weighted sample of those keys gives quantile boundaries, the
records are range-partitioned by them, ranges that turn out overfull are sampled again and subdivided until none is,
and whole ranges are packed into shards so that the shards' bytes are near equal. Equal texts have equal keys and so share
a range and a shard, unless one group of copies alone outweighs a shard: only then it is split by its ids, and rows of one
id, or none, by their number.

The number of ranges is fixed, so the driver sees the same few thousand sample keys and ranges at any size of the table.
Slots are counted in cells of about CELL_BYTES, pieces of a range by the leading bits of the key (and by ids, where one
text's copies alone are more), whose starts are summed in Spark: no task sorts more than a cell.

Defined cases: a null text counts no bytes and hashes as the empty text; null ids and repeated rows are placed like any
other; an empty table gives an empty result; columns of the input that clash with an output column are replaced, all
others are carried along, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, number_within, without

OUTPUT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
RECORD_BYTES = 8
CELL_BYTES = 64 << 20
BROADCAST_ROWS = 200_000


def size_of(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long") + RECORD_BYTES


def _chance(*cols: Column) -> Column:
    """A number in (0, 1) that depends on the values alone, so that reruns draw the same sample."""
    return (F.pmod(F.xxhash64(F.lit("draw"), *cols), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def _range_of(text_hash: Column, id_hash: Column, splitters: np.ndarray, split_hashes: np.ndarray, split_into: int) -> Column:
    """Number of the range that a key falls in; the few hashes in split_hashes have split_into ranges each, after the others."""

    @F.pandas_udf("int")
    def place(h: pd.Series, k: pd.Series) -> pd.Series:
        v = h.to_numpy(np.int64)
        out = np.searchsorted(splitters, v, side="right").astype(np.int64)
        if len(split_hashes):
            at = np.minimum(np.searchsorted(split_hashes, v), len(split_hashes) - 1)
            heavy = split_hashes[at] == v
            piece = (k.to_numpy(np.int64).view(np.uint64) % np.uint64(split_into)).astype(np.int64)
            out[heavy] = len(splitters) + 1 + at[heavy] * split_into + piece[heavy]
        return pd.Series(out.astype(np.int32))

    return place(text_hash, id_hash)


def pack(sizes: Sequence[tuple[int, int]], n_shards: int) -> dict[int, int]:
    """Largest range first into the lightest shard: range -> shard."""
    load = [(0, s) for s in range(n_shards)]
    placed = {}
    for r, b in sorted(sizes, key=lambda x: (-x[1], x[0])):
        total, s = heapq.heappop(load)
        placed[r] = s
        heapq.heappush(load, (total + b, s))
    return placed


def _join_small(df: DataFrame, small: DataFrame, *on: str, how: str = "inner") -> DataFrame:
    """Join to a written table whose rows are counted: broadcast when few, a sort-merge join beyond."""
    return df.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small.hint("merge"), list(on), how)


def splitters(narrow: DataFrame, total: int, heavy: np.ndarray, n_ranges: int, sample_per_range: int = 16) -> tuple[np.ndarray, list]:
    """Boundaries of ranges over narrow (h, k, b), none over twice its share unless it is one text's copies, and the ranges (r, b, low, high)."""
    ideal = max(1.0, total / n_ranges)

    def draw(df: DataFrame, rate: float) -> list[int]:
        return [r["h"] for r in df.where(_chance(F.col("h"), F.col("k")) < F.col("b") * F.lit(float(rate))).select("h").collect()]

    sample = np.sort(np.array(draw(narrow, sample_per_range / ideal), dtype=np.int64))
    cuts = np.unique(sample[np.linspace(0, len(sample), n_ranges + 1).astype(int)[1:-1]]) if len(sample) else sample
    for again in range(1, 12):
        place = _range_of(F.col("h"), F.col("k"), cuts, heavy, n_ranges)
        ranges = narrow.withColumn("r", place).groupBy("r").agg(F.sum("b").alias("b"), F.min("h").alias("low"), F.max("h").alias("high")).collect()
        over = [r for r in ranges if r["b"] > 2 * ideal and r["low"] < r["high"]]
        if not over:
            return cuts, ranges
        # subdivide just these: groups of copies of a fourth of a range stand alone, a denser sample cuts the rest
        inside = narrow.withColumn("r", place).where(F.col("r").isin([r["r"] for r in over]))
        large = [r["h"] for r in inside.groupBy("h").agg(F.sum("b").alias("b")).where(F.col("b") > ideal / 4).select("h").collect()]
        more = np.unique(np.array(draw(inside, 4 * again * sample_per_range / ideal), dtype=np.int64))[:: again * sample_per_range]
        alone = [x for h in large for x in (h, min(h + 1, np.iinfo(np.int64).max))]
        cuts = np.unique(np.concatenate([cuts, more, np.array([*alone, *[r["high"] for r in over]], dtype=np.int64)]))
    raise RuntimeError("ranges stay overfull")


def _told_apart(carried: DataFrame, narrow: DataFrame, limit: float) -> tuple[DataFrame, DataFrame]:
    """Both with a k of its own for each row of one text and one (or no) id that are together more than limit bytes: they can stand for each other, so their number tells them apart."""
    crowds = narrow.groupBy("h", "k").agg(F.count("*").alias("_rows"), F.sum("b").alias("_bytes")).where((F.col("_rows") > 1) & (F.col("_bytes") > limit))
    crowds = materialise(crowds.select("h", "k"), "shard-repeated")
    if crowds.isEmpty():
        return carried, narrow
    own = number_within(_join_small(carried, crowds, "h", "k"), ["h", "k"], "shard-told-apart").withColumn("k", F.xxhash64("k", "_nth")).drop("_nth")
    rest = lambda df: _join_small(df, crowds, "h", "k", how="left_anti")
    return rest(carried).unionByName(own), rest(narrow).unionByName(own.select("h", "k", F.col("size").alias("b")))


def shard(docs: DataFrame, n_shards: int = 24, ranges_per_shard: int = 32, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """docs with size, text_crc32, law ('bytes'), shard, slot (gapless from 0 in a shard) and grown_shard (null)."""
    docs = without(docs, *OUTPUT)
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = (F.xxhash64(text).alias("h"), F.xxhash64(F.col("doc_id"), F.lit("piece")).alias("k"))
    narrow = materialise(docs.select(*keys, size_of(F.col("text")).alias("b")), "shard-keys")
    total = narrow.agg(F.sum("b")).first()[0] or 0
    carried = docs.select(F.struct("*").alias("_doc"), *keys, size_of(F.col("text")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    carried, narrow = _told_apart(carried, narrow, min(cell_bytes, total / n_shards / 16))
    n_ranges = n_shards * ranges_per_shard
    # groups of copies heavier than a shard: fewer than n_shards of them
    heavy = np.array(sorted(r["h"] for r in narrow.groupBy("h").agg(F.sum("b").alias("b")).where(F.col("b") > total / n_shards).collect()), dtype=np.int64)
    cuts, ranges = splitters(narrow, total, heavy, n_ranges)
    placed = pack([(r["r"], r["b"]) for r in ranges], n_shards)
    shards = spark.createDataFrame([(r["r"], placed[r["r"]]) for r in ranges], "r int, shard int")

    # one text's copies of more than a cell are cut by their ids too
    bits = max(1, int(total // cell_bytes).bit_length())
    crowded = narrow.groupBy("h").agg(F.sum("b").alias("b")).where(F.col("b") > cell_bytes)
    crowded = materialise(crowded.select("h", F.ceil(F.col("b") / cell_bytes).cast("long").alias("pieces")), "shard-crowded")
    crowds = not crowded.isEmpty()

    def in_cells(df: DataFrame) -> DataFrame:
        df = df.withColumn("r", _range_of(F.col("h"), F.col("k"), cuts, heavy, n_ranges)).withColumn("sub", F.shiftright("h", 64 - bits))
        if crowds:
            df = _join_small(df, crowded, "h", how="left").withColumn("piece", F.pmod("k", F.coalesce("pieces", F.lit(1)))).drop("pieces")
        else:
            df = df.withColumn("piece", F.lit(0).cast("long"))
        return df.join(F.broadcast(shards), "r")  # n_ranges rows and a few

    cells = in_cells(narrow).groupBy("shard", "r", "sub", "piece").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("r", "sub", "piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialise(cells.select("r", "sub", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")), "shard-cells")
    in_cell = Window.partitionBy("r", "sub", "piece").orderBy("h", "k")
    rows = _join_small(in_cells(carried), starts, "r", "sub", "piece").withColumn("row", F.row_number().over(in_cell) - 1)
    slot, grown = (F.col("start") + F.col("row")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    return rows.select("_doc.*", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot, grown)
