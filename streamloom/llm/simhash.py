"""SimHash near-duplicates with a Gray-order hierarchical index.

A document's fingerprint has a bit where over half of its three-word shingles' hashes have it. Fingerprints link at three
or fewer differing bits; a document's component is the smallest doc_id that it reaches over links.

Search: the 64 bits are cut into five blocks. Of two linked fingerprints at least two blocks agree, so for each of the
ten pairs of blocks the fingerprints are dealt by those blocks' bits. A task sorts what it got by Gray rank with the
agreeing blocks on top and builds a binary hierarchy over that order: a node holds the bits that all fingerprints below
it share. Node pairs are compared from the top by the differing bits among those both share; a pair over the limit, or
differing in the agreeing blocks, is dropped with everything below it. A task hands on a spanning forest of its links,
never all pairs, and the components join the forests. Exact at any size: nothing is capped.

Defined cases: null and blank texts have the zero fingerprint and link like any other; texts under three words are one
shingle; long texts are hashed in pieces; copies share a fingerprint and are searched once; a null id keeps its
fingerprint and takes the component of its fingerprint's group, or null where that group has no id; an empty table gives
an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lighter_batches, materialise, small_batches
from .components import components

SEED, WORDS, LIMIT = 42, 3, 3
#: (first bit, width) of the blocks.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
TABLES = tuple(combinations(range(len(BLOCKS)), len(BLOCKS) - LIMIT))
PIECE = 1 << 22
PAIRS_AT_ONCE = 1 << 20


def word_pieces(data: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The words of data, piece bytes at a time and cut at white space only."""
    at, held = 0, b""
    while at < len(data):
        part = held + data[at : at + piece]
        at += piece
        words = part.split()
        if at < len(data) and words and not part[-1:].isspace():
            held = words.pop()
        else:
            held = b""
        yield words


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(b" ".join(t), SEED) for t in zip(words, words[1:], words[2:])], dtype=np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit, least significant first."""
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64)
        cut = len(bits) // 255 * 255
        total += bits[:cut].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[cut:].sum(0, dtype=np.int64)
    return total


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of a text, as an unsigned number."""
    counts, n, held = np.zeros(64, dtype=np.int64), 0, []
    for words in word_pieces((text or "").encode("utf-8", "surrogatepass").lower()):
        words = held + words
        if len(words) >= WORDS:
            hashes = shingle_hashes(words)
            counts += bit_counts(hashes)
            n += len(hashes)
        held = words[-(WORDS - 1) :]
    if not n:
        if not held:
            return 0
        return xxhash.xxh64_intdigest(b" ".join(held), SEED)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) with fp the fingerprint's bits as a signed long."""
    lighter_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            fps = np.array([fingerprint(t) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _on_top(fps: np.ndarray, table: int) -> tuple[np.ndarray, int]:
    """The fingerprints with the table's agreeing blocks moved to the top, and how many bits those have."""
    order = [*TABLES[table], *[b for b in range(len(BLOCKS)) if b not in TABLES[table]]]
    out, width = np.zeros_like(fps), 0
    for b in order:
        low, n = BLOCKS[b]
        out = (out << np.uint64(n)) | ((fps >> np.uint64(low)) & np.uint64((1 << n) - 1))
        if b in TABLES[table]:
            width += n
    return out, width


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each number in the reflected Gray order."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


def links(values: np.ndarray, limit: int = LIMIT, agree: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j in the sorted order) of values in Gray order that differ in limit bits at most, none of the top agree bits."""
    n = len(values)
    if n < 2:
        return
    size = 1 << int(n - 1).bit_length()
    every = np.concatenate([values, np.full(size - n, values[-1], dtype=np.uint64)])
    levels = [(every, every)]  # (bits set in all, bits set in any), leaves first
    while len(levels[-1][0]) > 1:
        low, high = levels[-1]
        levels.append((low[::2] & low[1::2], high[::2] | high[1::2]))
    top = ~np.uint64(0) << np.uint64(64 - agree) if agree else np.uint64(0)
    work = [(len(levels) - 1, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
    while work:
        level, a, b = work.pop()
        if level == 0:
            yield a, b
            continue
        same, apart = a == b, a != b
        x = np.concatenate([2 * a, 2 * a[same] + 1, 2 * a, 2 * a[apart] + 1, 2 * a[apart] + 1])
        y = np.concatenate([2 * b, 2 * b[same] + 1, 2 * b + 1, 2 * b[apart], 2 * b[apart] + 1])
        level -= 1
        if level == 0:
            proper = (x != y) & (x < n) & (y < n)
        else:
            proper = (x << level < n) & (y << level < n)
        x, y = x[proper], y[proper]
        low, high = levels[level]
        shared = ~(low[x] ^ high[x]) & ~(low[y] ^ high[y])
        differ = (low[x] ^ low[y]) & shared
        keep = (np.bitwise_count(differ) <= limit) & ((differ & top) == 0)
        x, y = x[keep], y[keep]
        work += [(level, x[i : i + PAIRS_AT_ONCE], y[i : i + PAIRS_AT_ONCE]) for i in range(0, len(x), PAIRS_AT_ONCE)]


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (index of the least member known) after joining a with b pairwise."""
    while True:
        la, lb = label[a], label[b]
        if (open_ := la != lb).sum() == 0:
            return label
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(down := label[label], label):
            label = down


def forest(fps: DataFrame, n_parts: int) -> DataFrame:
    """Edges (u, v) between ids of linked fingerprints (fp, id): a spanning forest of each task's links."""
    keys = []
    for t, blocks in enumerate(TABLES):
        bits = [F.shiftrightunsigned("fp", BLOCKS[b][0]).bitwiseAND(F.lit((1 << BLOCKS[b][1]) - 1)) for b in blocks]
        keys.append(F.xxhash64(F.lit(t), *bits))
    dealt = fps.select("fp", "id", F.posexplode(F.array(*keys)).alias("t", "key")).repartition(n_parts, "key").select("t", "fp", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches if b.num_rows]
        if not got:
            return
        t, fp, ids = (np.concatenate(x) for x in zip(*got))
        for table in range(len(TABLES)):
            at = np.flatnonzero(t == table)
            if len(at) < 2:
                continue
            moved, width = _on_top(fp[at].view(np.uint64), table)
            order = np.argsort(gray_rank(moved), kind="stable")
            label = np.arange(len(at))
            for a, b in links(moved[order], LIMIT, width):
                label = merge(label, a, b)
            own = ids[at[order]]
            tied = np.flatnonzero(label != np.arange(len(at)))
            if len(tied):
                yield pa.RecordBatch.from_arrays([pa.array(own[tied]), pa.array(own[label[tied]])], ["u", "v"])

    return dealt.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, rows_per_part: int = 2_000_000) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs."""
    spark = docs.sparkSession
    hashed = materialise(fingerprints(docs), "simhash")
    distinct = materialise(hashed.groupBy("fp").agg(F.min("doc_id").alias("id")), "simhash-distinct")
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), distinct.count() * len(TABLES) // rows_per_part)
    edges = forest(distinct.where("id is not null"), n_parts)
    groups = distinct.join(components(edges).withColumnRenamed("node", "id"), "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return hashed.join(groups.hint("merge"), "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row left of each component: that of the smallest doc_id. Rows whose group has no id stay once a fingerprint."""
    groups = near_duplicates(docs)
    stay = groups.where(F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id"))).select("doc_id").distinct()
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["doc_id"]), "left_semi").dropDuplicates(["doc_id", "text"] if "text" in docs.columns else ["doc_id"])
