"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is its set of five-word shingles over lower-cased runs of letters and digits. Items are partitioned by the
number of their shingles; a partition with at most u of them has bottom-k MinHash sketches of k = floor((1 - t) u) + 1
minima. A document that contains the share t of an item misses at most floor((1 - t) u) of its shingles, so it holds at
least one of the k minima: the search for sketch entries among a document's shingles finds every such pair, however long
the document. Candidate pairs are verified by exact containment of the shingles themselves.

Items are taken in blocks of a bounded size, so that each broadcast stays bounded for any benchmark; each block is
searched in all documents, and a row carries what was found in it through the blocks.

Defined cases: null and blank texts are not contaminated, null and blank items match nothing; an item under five words
is one shingle of its words and must appear whole; repeated items count by their ids; empty tables give no matches;
only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lighter_batches
from .textarrays import STEPS, batches, mixed, span_hash

WORDS, SHARE = 5, 0.8
BLOCK_BYTES = 16 << 20
_WORD = re.compile(r"[^\W_]+")


def tokens(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return _WORD.findall((text or "").lower())


def shingles(words: list[str], n: int = WORDS) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def shingle_hash(words: tuple[str, ...]) -> int:
    return int(mixed(np.array([sum(span_hash(w) * int(s) for w, s in zip(words, STEPS)) & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64))[0])


def size_class(n: int) -> int:
    """Upper bound of the size partition that n shingles fall in."""
    return 1 << max(0, n - 1).bit_length()


def sketch(items: list[tuple[int, str | None]], share: float = SHARE) -> tuple[dict[int, set[tuple[str, ...]]], dict[int, dict[int, list[int]]]]:
    """Shingle sets by place, and for each shingle length the sketch entries: hash -> places of the items that have it."""
    sets, entries = {}, {}
    for at, (_, text) in enumerate(items):
        words = tokens(text)
        n = min(WORDS, len(words))
        if not n:
            continue
        sets[at] = shingles(words, n)
        k = int((1 - share) * size_class(len(sets[at])) + 1e-9) + 1
        for h in sorted(map(shingle_hash, sets[at]))[:k]:
            entries.setdefault(n, {}).setdefault(h, []).append(at)
    return sets, entries


class Matcher:
    """Finds the items of one block in batches of texts; sent to the tasks as a broadcast."""

    def __init__(self, items: list[tuple[int, str | None]], share: float):
        self.share, self.ids = share, [i for i, _ in items]
        self.sets, entries = sketch(items, share)
        self.probes = {n: (np.array(sorted(e), dtype=np.uint64), e) for n, e in entries.items()}
        self.flags = {}
        for n, (hashes, _) in self.probes.items():
            self.flags[n] = np.zeros(1 << 20, dtype=bool)
            self.flags[n][hashes & np.uint64((1 << 20) - 1)] = True

    def candidates(self, texts: list[str | None]) -> dict[int, set[int]]:
        """Row -> places of items of whose sketch the row has an entry."""
        found: dict[int, set[int]] = {}
        tails: dict[int, np.ndarray] = {}
        for chars, rows, starts in batches(texts):
            low, high = chars.words("LN")
            hashed = chars.hashes(low, high)
            owner = np.array(rows)[np.searchsorted(starts, low, side="right") - 1]
            first = rows[0]
            if first in tails:  # a long text goes on: its last words come again
                hashed, owner = np.concatenate([tails[first], hashed]), np.concatenate([np.full(len(tails[first]), first), owner])
            tails = {rows[-1]: hashed[owner == rows[-1]][-(WORDS - 1) :]}
            for n, (hashes, entry) in self.probes.items():
                m = len(hashed) - n + 1
                if m < 1:
                    continue
                s = np.zeros(m, dtype=np.uint64)
                for k in range(n):
                    s += hashed[k : k + m] * STEPS[k]
                s = mixed(s)
                hit = np.flatnonzero(self.flags[n][s & np.uint64((1 << 20) - 1)] & (owner[:m] == owner[n - 1 :]))
                at = np.minimum(np.searchsorted(hashes, s[hit]), len(hashes) - 1)
                same = hashes[at] == s[hit]
                for i, a in zip(hit[same], at[same]):
                    found.setdefault(int(owner[i]), set()).update(entry[int(hashes[a])])
        return found

    def matches(self, texts: list[str | None]) -> dict[int, list[dict]]:
        """Row -> the items that it contains, verified."""
        out: dict[int, list[dict]] = {}
        for row, places in self.candidates(texts).items():
            words = tokens(texts[row])
            own = {n: shingles(words, n) for n in {len(next(iter(self.sets[p]))) for p in places}}
            for p in sorted(places):
                c = len(self.sets[p] & own[len(next(iter(self.sets[p])))]) / len(self.sets[p])
                if c >= self.share:
                    out.setdefault(row, []).append({"item_id": self.ids[p], "containment": c})
        return out


FOUND = pa.list_(pa.struct([("item_id", pa.int64()), ("containment", pa.float64())]))
FOUND_SQL = "array<struct<item_id long, containment double>>"


def find(docs: DataFrame, items: list[tuple[int, str | None]], share: float = SHARE) -> DataFrame:
    """docs (doc_id, text) -> a row for each document with the ids and containments of the items found in it."""
    return find_blocks(docs, iter([items]), share)


def find_blocks(docs: DataFrame, blocks: Iterator[list[tuple[int, str | None]]], share: float = SHARE) -> DataFrame:
    """find for items in blocks: each adds to the row's own list, so that no row is looked up by its doc_id."""
    lighter_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items, first = next(blocks), True
    while items is not None:
        known, items = docs.sparkSession.sparkContext.broadcast(Matcher(items, share)), next(blocks, None)
        names = ["doc_id", "found"] if items is None else ["doc_id", "found", "text"]

        def run(got: Iterator[pa.RecordBatch], known=known, names=names, first=first) -> Iterator[pa.RecordBatch]:
            for b in got:
                found = known.value.matches(b.column("text").to_pylist())
                every = [found.get(i, []) for i in range(b.num_rows)]
                if not first:
                    every = [old + new for old, new in zip(b.column("found").to_pylist(), every)]
                of = {"doc_id": b.column("doc_id"), "found": pa.array(every, FOUND), "text": b.column("text")}
                yield pa.RecordBatch.from_arrays([of[n] for n in names], names)

        types = {"doc_id": "long", "found": FOUND_SQL, "text": "string"}
        rows, first = rows.mapInArrow(run, ", ".join(f"{n} {types[n]}" for n in names)), False
    return rows


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """The benchmark's items in blocks of about BLOCK_BYTES."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // BLOCK_BYTES) + 1
    for k in range(n):
        yield [(r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids, max_containment), one row for each row of docs."""
    out = find_blocks(docs, item_blocks(benchmark), share)
    return out.select(
        "doc_id",
        (F.size("found") > 0).alias("contaminated"),
        F.size("found").cast("long").alias("n_items"),
        F.array_sort(F.col("found.item_id")).alias("item_ids"),
        F.coalesce(F.array_max(F.col("found.containment")), F.lit(0.0)).alias("max_containment"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """docs without the rows whose text contains a test item; rows are filtered where they are, texts are never shuffled."""
    lighter_batches(docs.sparkSession)
    at = docs.columns.index("text")
    for items in item_blocks(benchmark):
        known = docs.sparkSession.sparkContext.broadcast(Matcher(items, share))

        def run(got: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for b in got:
                found = known.value.matches(b.column(at).to_pylist())
                yield b.filter(pa.array([i not in found for i in range(b.num_rows)], pa.bool_())) if found else b

        docs = docs.mapInArrow(run, docs.schema)
    return docs
