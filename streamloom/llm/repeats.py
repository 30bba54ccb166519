"""Removal of repeated byte strings: exact substring deduplication over sampled suffixes.

A byte goes when a LENGTH-byte string that covers it also starts earlier, in a smaller doc_id or before it in the same
document. Sorting every suffix of the corpus carries a tuple for each byte of text through each round; here only sampled
suffixes are named, and what holds for the others is induced from them:

1. Sample. Every LENGTH-byte window picks one suffix inside it, the one whose first GRAM bytes hash lowest. Equal windows
   pick alike, so copies are sampled alike wherever they stand, at about one position in 35.
2. Name. A sampled suffix carries two names: of its first GRAM bytes and of its context, all bytes of the windows that
   picked it. Grouped by the first name, a context seen before repeats whole; a context that shares its first bytes with
   other contexts is open; one alone with its bytes has no repeated window at all.
3. Induce. Only windows of open suffixes are named one by one; the first of each name, in document order, stays.

Steps 1 and 3 aggregate inside a batch or block before they shuffle, so that a passage copied into any share of all
documents meets as one row a block, and a first name that is very common in a batch goes straight to step 3. Names are
64-bit hashes. Tasks exchange packed arrays, in buckets and blocks of bounded size.

Defined cases: a null text is empty; texts under LENGTH bytes keep all; texts of any length are sampled in pieces; rows
with one doc_id and one text are one document and get one result each; other rows of one doc_id are ordered by their
text's hash; a null doc_id comes after all others; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .textarrays import BASE, mixed

LENGTH, GRAM = 100, 32
PIECE = 1 << 20
HOT = 16
BLOCK_BYTES = 24 << 20
LAST = np.iinfo(np.int64).max
WHOLE, OPEN = 1, 2  # what becomes known of a sampled suffix: all its windows repeat; each has to be looked at


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    def up(x: int) -> np.ndarray:
        out = np.full(PIECE + LENGTH + 2, x, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return up(int(BASE)), up(pow(int(BASE), -1, 1 << 64))


class Sample:
    """Sampled suffixes of one piece of a text: place, first and last window, names; and the names of single windows."""

    def __init__(self, data: np.ndarray, offset: int):
        up, self.down = _powers()
        n = len(data)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=self.sums[1:])
        grams = mixed((self.sums[GRAM:] - self.sums[:-GRAM]) * self.down[: n - GRAM + 1])
        least = (grams & ~np.uint64(0xFFFFFF)) | np.arange(len(grams), dtype=np.uint64)  # of equal ones the leftmost
        span, width = 1, LENGTH - GRAM + 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        picked = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        self.low = np.flatnonzero(np.concatenate([[True], picked[1:] != picked[:-1]]))
        self.high = np.concatenate([self.low[1:], [len(picked)]])  # windows [low, high)
        at = picked[self.low]
        self.offset = offset
        self.at = at + offset
        self.gram = mixed(grams[at] ^ BASE)
        ends = self.high - 1 + LENGTH
        self.context = mixed((self.sums[ends] - self.sums[self.low]) * self.down[self.low] ^ (at - self.low).astype(np.uint64) * BASE)

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First bytes and names of all windows of these sampled suffixes."""
        n = self.high[which] - self.low[which]
        s = np.repeat(self.low[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return s + self.offset, mixed((self.sums[s + LENGTH] - self.sums[s]) * self.down[s])


def samples(text: bytes) -> Iterator[Sample]:
    data = np.frombuffer(text, dtype=np.uint8)
    for at in range(0, max(0, len(data) - LENGTH + 1), PIECE):
        yield Sample(data[at : at + PIECE + LENGTH - 1], at)


def place_base(text: bytes) -> int:
    """Added to the positions of a text, so that two texts of one doc_id are told apart and ordered."""
    return (xxhash.xxh64_intdigest(text) >> 49) << 48


def block_of(doc: np.ndarray, n_blocks: int) -> np.ndarray:
    return (mixed(doc.astype(np.int64).view(np.uint64)) % np.uint64(n_blocks)).astype(np.int64)


def pack(*columns: np.ndarray) -> bytes:
    """Equal-length 64-bit columns as one compressed string; the first two as differences."""
    parts = [np.diff(c.view(np.int64), prepend=0) if i < 2 else c for i, c in enumerate(columns)]
    return zstandard.compress(b"".join(p.tobytes() for p in parts), 1)


def unpack(blobs: list[bytes], n: int) -> list[np.ndarray]:
    """The columns of several packed strings, one after the other."""
    tables = []
    for blob in blobs:
        table = np.frombuffer(zstandard.decompress(blob), dtype=np.uint64).reshape(n, -1).copy()
        table[:2] = np.cumsum(table[:2], axis=1)
        tables.append(table)
    return list(np.concatenate(tables, axis=1)) if tables else [np.zeros(0, dtype=np.uint64)] * n


def _slices(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(keys, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(keys[order])) + 1):
        if len(part):
            yield int(keys[part[0]]), part


def _firsts(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys (the last of them first) and which of the order begins a new value of the last key."""
    order = np.lexsort(keys)
    top = keys[-1][order]
    return order, np.concatenate([[True], top[1:] != top[:-1]]) if len(top) else np.zeros(0, dtype=bool)


def _rows(*rows: tuple) -> pa.RecordBatch:
    keys, kinds, blobs = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], ["key", "kind", "blob"])


ROW = "key long, kind int, blob binary"
_ANCHORS, _KNOWN, _STUBS, _LOST = range(4)


def _known(doc: np.ndarray, at: np.ndarray, what: np.ndarray, n_blocks: int, shift: int = 0) -> list[tuple]:
    """Rows that tell each block what is known of its sampled suffixes."""
    order = np.lexsort((at, doc.view(np.int64)))
    doc, at, what = doc[order], at[order], what[order]
    return [(shift + b, _KNOWN, pack(doc[i], at[i], what[i])) for b, i in _slices(block_of(doc, n_blocks))]


def _name_batch(ids: np.ndarray, texts: list[bytes], n_buckets: int, n_blocks: int) -> list[tuple]:
    """Step 1 and the part of step 2 that a batch can do alone."""
    doc, at, gram, context = [], [], [], []
    for i, text in zip(ids, texts):
        base = place_base(text)
        for s in samples(text):
            doc.append(np.full(len(s.at), i, dtype=np.int64).view(np.uint64))
            at.append((s.at + base).astype(np.uint64))
            gram.append(s.gram)
            context.append(s.context)
    if not doc:
        return []
    doc, at, gram, context = map(np.concatenate, (doc, at, gram, context))
    order, first = _firsts(at, doc.view(np.int64), context)
    again = order[~first]
    # the same suffix of the same document may come twice in a batch: such rows are one document
    lead = np.repeat(order[first], np.diff(np.append(np.flatnonzero(first), len(order))))[~first]
    again = again[(doc[again] != doc[lead]) | (at[again] != at[lead])]
    rep = np.sort(order[first])
    out = _known(doc[again], at[again], np.full(len(again), WHOLE, dtype=np.uint64), n_blocks, n_buckets)
    doc, at, gram, context = doc[rep], at[rep], gram[rep], context[rep]
    _, group, n = np.unique(gram, return_inverse=True, return_counts=True)
    hot = n[group] >= HOT
    out += _known(doc[hot], at[hot], np.full(hot.sum(), OPEN, dtype=np.uint64), n_blocks, n_buckets)
    stubs = np.unique(gram[hot])
    out += [(b, _STUBS, pack(stubs[i])) for b, i in _slices((stubs % np.uint64(n_buckets)).astype(np.int64))]
    doc, at, gram, context = doc[~hot], at[~hot], gram[~hot], context[~hot]
    return out + [(b, _ANCHORS, pack(doc[i], at[i], gram[i], context[i])) for b, i in _slices((gram % np.uint64(n_buckets)).astype(np.int64))]


def _name_bucket(table: pa.Table, n_buckets: int, n_blocks: int) -> list[tuple]:
    """Step 2 for one bucket of first names; rows on their way to a block pass."""
    rows = list(zip(*(table.column(c).to_pylist() for c in range(3))))
    if rows[0][0] >= n_buckets:
        return [(key - n_buckets, kind, blob) for key, kind, blob in rows]
    doc, at, gram, context = unpack([b for _, k, b in rows if k == _ANCHORS], 4)
    if not len(doc):
        return []
    stubs = unpack([b for _, k, b in rows if k == _STUBS], 1)[0]
    order = np.lexsort((at, doc.view(np.int64), context, gram))
    doc, at, gram, context = doc[order], at[order], gram[order], context[order]
    new_gram = np.concatenate([[True], gram[1:] != gram[:-1]])
    new = new_gram | np.concatenate([[True], context[1:] != context[:-1]])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    whole = ~new & ((doc != doc[lead]) | (at != at[lead]))
    group = np.cumsum(new_gram) - 1
    open_ = new & ((np.bincount(group[new])[group] > 1) | np.isin(gram, stubs))
    tell = whole | open_
    return _known(doc[tell], at[tell], np.where(whole[tell], WHOLE, OPEN).astype(np.uint64), n_blocks)


class Block:
    """The documents of a block and what is known of their sampled suffixes."""

    def __init__(self, docs: pa.Table, known: pa.Table):
        self.ids = docs.column("doc_id")
        self.order = docs.column("order").to_numpy().astype(np.int64)
        self.blobs = docs.column("blob")
        rows = list(zip(known.column("kind").to_pylist(), known.column("blob").to_pylist()))
        doc, at, what = unpack([b for k, b in rows if k == _KNOWN], 3)
        self.lost = np.unique(unpack([b for k, b in rows if k == _LOST], 1)[0])
        self.what: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for d, i in _slices(doc.view(np.int64)):
            i = i[np.argsort(at[i], kind="stable")]
            self.what[d] = at[i], what[i]

    def text(self, k: int) -> bytes:
        return zstandard.decompress(self.blobs[k].as_py())

    def marked(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and end of the runs of windows that repeat whole; first bytes and names of the windows to look at."""
        at, what = self.what[self.order[k]]
        text = self.text(k)
        base = place_base(text)
        low, high, starts, names = ([np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)])
        # a suffix at the edge of two pieces is told of twice: it repeats whole only if both are
        first, last = np.searchsorted(at, at), np.searchsorted(at, at, side="right")
        seen = np.concatenate([[0], np.cumsum(what == OPEN)])
        open_ = seen[last] > seen[first]
        for s in samples(text):
            own = (s.at + base).astype(np.uint64)
            where = np.minimum(np.searchsorted(at, own), len(at) - 1)
            told = at[where] == own
            whole = np.flatnonzero(told & ~open_[where])
            low.append(s.low[whole] + s.offset)
            high.append(s.high[whole] + s.offset)
            at_first, name = s.windows(np.flatnonzero(told & open_[where]))
            starts.append(at_first)
            names.append(name)
        return np.concatenate(low), np.concatenate(high), np.concatenate(starts), np.concatenate(names)

    def look(self) -> tuple[dict[int, tuple], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """What is marked in each document, and (name, document, place) of the first of each name among the block's windows to look at."""
        marks = {k: self.marked(k) for k in range(len(self.order)) if self.order[k] in self.what}
        if not marks:
            return {}, (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64))
        names = np.concatenate([m[3] for m in marks.values()])
        docs = np.concatenate([np.full(len(m[3]), self.order[k]) for k, m in marks.items()])
        places = np.concatenate([m[2].astype(np.uint64) + np.uint64(place_base(self.text(k))) for k, m in marks.items()])
        order, first = _firsts(places, docs, names)
        return marks, (names[order[first]], docs[order[first]], places[order[first]])

    def open_windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.look()[1]

    def removed(self) -> Iterator[tuple[int, np.ndarray | None, bytes]]:
        """For each document its covered bytes, None for none, and its text."""
        marks, (names, docs, places) = self.look()
        for k in range(len(self.order)):
            text = self.text(k)
            if k not in marks:
                yield k, None, text
                continue
            low, high, starts, own = marks[k]
            edge = np.bincount(low, minlength=len(text) + 1) - np.bincount(high - 1 + LENGTH, minlength=len(text) + 1)
            if len(own):
                i = np.searchsorted(names, own)
                first = (docs[i] == self.order[k]) & (places[i] == starts.astype(np.uint64) + np.uint64(place_base(text)))
                if len(self.lost):
                    first &= self.lost[np.minimum(np.searchsorted(self.lost, own), len(self.lost) - 1)] != own
                again = starts[~first]
                edge += np.bincount(again, minlength=len(text) + 1) - np.bincount(again + LENGTH, minlength=len(text) + 1)
            yield k, np.cumsum(edge[:-1]) > 0, text


def _as_table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_rows(*rows)] if rows else [], _rows((0, 0, b"")).schema)


DOC = "block long, doc_id long, order long, blob binary"


def by_block(docs: DataFrame, n_blocks: int) -> DataFrame:
    """Compressed texts with their block."""

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in got:
            order = b.column(0).fill_null(LAST).to_numpy()
            blobs = pa.array([zstandard.compress((t or "").encode("utf-8", "surrogatepass"), 1) for t in b.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(block_of(order, n_blocks)), b.column(0), pa.array(order), blobs], ["block", "doc_id", "order", "blob"])

    return docs.mapInArrow(run, DOC)


def _meet(docs: DataFrame, known: DataFrame, n_blocks: int, work, schema: str) -> DataFrame:
    return by_block(docs, n_blocks).groupBy("block").cogroup(known.groupBy("key")).applyInArrow(work, schema)


def find_known(docs: DataFrame, n_buckets: int, n_blocks: int) -> DataFrame:
    def name(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in got:
            ids = b.column(0).fill_null(LAST).to_numpy()
            rows = _name_batch(ids, [(t or "").encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()], n_buckets, n_blocks)
            if rows:
                yield _rows(*rows)

    named = docs.mapInArrow(name, ROW)
    return named.groupBy("key").applyInArrow(lambda t: _as_table(_name_bucket(t, n_buckets, n_blocks)), ROW)


def find_lost(docs: DataFrame, known: DataFrame, n_buckets: int, n_blocks: int) -> DataFrame:
    """Step 3 across blocks: names of windows whose first is in another block."""

    def ask(docs: pa.Table, known: pa.Table) -> pa.Table:
        if not docs.num_rows or not known.num_rows:
            return _as_table([])
        block = Block(docs, known)
        if not block.what:
            return _as_table([])
        at = docs.column("block")[0].as_py()
        names, doc, place = block.open_windows()
        rows = []
        for bucket, i in _slices((names % np.uint64(n_buckets)).astype(np.int64)):
            i = i[np.lexsort((place[i], doc[i]))]
            rows.append((bucket, at, pack(doc[i].view(np.uint64), place[i], names[i])))
        return _as_table(rows)

    def answer(table: pa.Table) -> pa.Table:
        blocks, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()
        parts = [unpack([b], 3) for b in blobs]
        doc, place, names = (np.concatenate([p[c] for p in parts]) for c in range(3))
        block = np.repeat(np.array(blocks, dtype=np.int64), [len(p[0]) for p in parts])
        order, first = _firsts(place, doc.view(np.int64), names)
        late = order[~first]
        return _as_table([(b, _LOST, pack(np.sort(names[late[i]]))) for b, i in _slices(block[late])])

    return _meet(docs, known, n_blocks, ask, ROW).groupBy("key").applyInArrow(answer, ROW)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, with_text: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row, and with_text the kept bytes."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = int(total // block_bytes) + 1
    n_buckets = max(n_blocks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    known = materialise(find_known(docs, n_buckets, n_blocks), "repeats-known")
    lost = materialise(find_lost(docs, known, n_buckets, n_blocks), "repeats-lost")

    def cut(docs: pa.Table, known: pa.Table) -> pa.Table:
        ids, rows = docs.column("doc_id"), []
        if docs.num_rows:
            for k, gone, text in Block(docs, known).removed():
                kept, n, spans = text, 0, 0
                if gone is not None and gone.any():
                    kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
                    n, spans = int(gone.sum()), int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
                rows.append((ids[k].as_py(), len(text), n, spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        columns = list(zip(*rows)) or [[]] * 6
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        n = 6 if with_text else 5
        return pa.table([pa.array(c, t) for c, t in zip(columns[:n], types)], names[:n])

    return _meet(docs, known.unionByName(lost), n_blocks, cut, RESULT + (", kept binary" if with_text else ""))
