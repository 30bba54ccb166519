"""Token ids of every text in compact files, and back.

Texts are encoded once into a table of ids; the ids' global counts give a canonical length-limited Huffman code (see
huffman). The ids are then put in ascending doc_id order by range partitions and written as blocks of whole documents:
one row a block with the position of its first id among all ids, the documents and their lengths, checkpoints and the
coded payload. The code lengths lie beside the blocks. A reader needs a block and the lengths only.

Defined cases: a null text is the empty text, whose only id is the end id; rows of a repeated or null id keep their own
ids, null first, in the order of their ids' hash; a text of any length is one block's document; an empty table writes no
block; only doc_id and text are read.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lighter_batches, materialise, shared_folder, small_batches
from .huffman import Decoder, canonical_codes, code_lengths, encode
from .textarrays import CHARS_AT_ONCE, STEPS, Chars, mixed

END = 0
BLOCK_IDS = 1 << 18
RANGE_IDS = 1 << 24
#: Parts of texts whose ids a task knows, and those of them that are not yet sorted in.
CACHED_PARTS, NEWEST_PARTS = 2_000_000, 100_000
#: Texts of these characters alone are split here; others, and those that may hold a special token, are encoded whole.
_PLAIN = re.compile(r"[\t\n\r -~¡-ɏ‐-‧‰-›€]*")
_SPACE, _LETTER, _NUMBER, _OTHER, _BREAK = range(5)
_CUT = re.compile(r"(?<=\S) (?=\S)")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point that a plain text may hold; 0 stands between texts."""
    kinds = {"L": _LETTER, "N": _NUMBER}
    out = np.array([kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x2100)], dtype=np.uint8)
    out[[9, 10, 13, 32]] = _SPACE
    out[0] = _BREAK
    return out


def part_starts(codes: np.ndarray) -> np.ndarray:
    """Where the parts begin that the tokenizer splits plain texts into: runs of letters, numbers or other marks, each
    with one space before it, the endings after an apostrophe, and white space, whose last character stands alone before text."""
    kind = _classes()[codes]
    first = np.concatenate([[True], kind[1:] != kind[:-1]])
    begin = np.flatnonzero(first)
    end = np.append(begin[1:], len(codes))
    start = first.copy()
    white = kind[begin] == _SPACE
    before_text = white & (end < len(codes))
    before_text[before_text] = kind[end[before_text]] != _BREAK
    last = end[before_text] - 1
    start[last] = True
    start[last[codes[last] == 32] + 1] = False
    # an apostrophe that no space precedes, alone, and the letters after it
    at = begin[(codes[begin] == 39) & (end - begin == 1)]
    at = at[(at + 1 < len(codes)) & start[at]]
    one = codes[at + 1]
    two = codes[np.minimum(at + 2, len(codes) - 1)]
    n = np.isin(one, [ord(c) for c in "stmd"]).astype(np.int64)
    for pair in ("re", "ve", "ll"):
        n[(one == ord(pair[0])) & (two == ord(pair[1]))] = 2
    at, n = at[n > 0], n[n > 0]
    start[at + 1] = False
    rest = at + 1 + n
    start[rest[rest < len(codes)]] = True
    return start


def _runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The n[i] indexes from first[i] on, for each i."""
    to = np.cumsum(n)
    return np.repeat(first - (to - n), n) + np.arange(to[-1] if len(to) else 0)


def _byte_letters() -> dict[int, int]:
    """Byte -> the letter that stands for it in a byte-level vocabulary: printable bytes for themselves, the others in order from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(others)}


class _Encoder:
    """Bytes of the ids (little-endian uint16) of the parts that the tokenizer splits a text into. Known parts are kept by their
    64-bit hash, the newest in a dict, the others in sorted arrays: some 30 bytes a part; all are forgotten when they are too many."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._forget()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        if any(self.part(p) != self.whole(p) for p in (" word", "é²", "!\"#", "\n\t")):
            raise ValueError("not a byte-level vocabulary")

    def _forget(self) -> None:
        self.newest: dict[int, bytes] = {}
        self.keys, self.ends, self.flat = np.zeros(0, dtype=np.uint64), np.zeros(1, dtype=np.int64), np.zeros(0, dtype="<u2")

    def _settle(self) -> None:
        """The newest parts join the sorted arrays."""
        if len(self.keys) + len(self.newest) > CACHED_PARTS:
            self._forget()
            return
        newest = sorted(self.newest)
        keys = np.concatenate([self.keys, np.array(newest, dtype=np.uint64)])
        own = [self.newest[k] for k in newest]
        n = np.concatenate([np.diff(self.ends), np.array([len(x) // 2 for x in own], dtype=np.int64)])
        flat = np.concatenate([self.flat, np.frombuffer(b"".join(own), dtype="<u2")])
        order = np.argsort(keys, kind="stable")  # two sorted runs
        first = (np.cumsum(n) - n)[order]
        self.newest, self.keys, n = {}, keys[order], n[order]
        self.ends = np.concatenate([[0], np.cumsum(n)])
        self.flat = flat[_runs(first, n)]

    def coded(self, text: str, keys: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts of text with these ascending keys, one after the other, and their numbers of ids."""
        if len(self.newest) >= NEWEST_PARTS:
            self._settle()
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), dtype=bool)
        first, n = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        first[known] = self.ends[at[known]]
        n[known] = self.ends[at[known] + 1] - first[known]
        rest = np.flatnonzero(~known)
        own, newest = [], self.newest
        for key, b, e in zip(keys[rest].tolist(), begin[rest].tolist(), end[rest].tolist()):
            ids = newest.get(key)
            if ids is None:
                ids = newest[key] = self.part(text[b:e])
            own.append(ids)
        n[rest] = [len(x) // 2 for x in own]
        first[rest] = len(self.flat) + np.cumsum(n[rest]) - n[rest]
        return np.concatenate([self.flat, np.frombuffer(b"".join(own), dtype="<u2")])[_runs(first, n)], n

    def part(self, part: str) -> bytes:
        """Ids of one part, straight from the model: a third of the time that the tokenizer takes with all its steps."""
        letters = part.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(letters)]
        return struct.pack(f"<{len(ids)}H", *ids)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()

    def texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        out: list[list[bytes]] = [[] for _ in texts]
        rows: list[int] = []
        held: list[str] = []
        size = 0
        for i, t in enumerate(texts):
            if "<|" in t or not _PLAIN.fullmatch(t):
                out[i].append(self.whole(t))
                continue
            at = 0
            while at < len(t):
                end = len(t)
                if end - at > CHARS_AT_ONCE // 2:  # cut a long text where a part begins anyway
                    cut = _CUT.search(t, at + CHARS_AT_ONCE // 4, at + CHARS_AT_ONCE // 2)
                    end = cut.start() if cut else end
                if end - at > CHARS_AT_ONCE // 2:
                    out[i].append(self.whole(t[at:]))
                    break
                if size + end - at + 1 > CHARS_AT_ONCE:
                    self._plain(rows, held, out)
                    rows, held, size = [], [], 0
                rows.append(i)
                held.append(t[at:end])
                size += end - at + 1
                at = end
        if held:
            self._plain(rows, held, out)
        return [b"".join(x) for x in out]

    def _plain(self, rows: list[int], held: list[str], out: list[list[bytes]]) -> None:
        text = "\0".join(held)
        chars = Chars(text)
        begin = np.flatnonzero(part_starts(chars.codes))
        end = np.append(begin[1:], len(text))
        part = chars.codes[begin] != 0
        begin, end = begin[part], end[part]
        hashes = mixed(chars.hashes(begin, end) + (end - begin).astype(np.uint64) * STEPS[0])
        keys, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        flat, length = self.coded(text, keys, begin[first], end[first])
        n = length[which]
        to = np.cumsum(n)
        ids = flat[_runs((np.cumsum(length) - length)[which], n)]
        ends = np.cumsum([len(h) + 1 for h in held])
        cuts = np.concatenate([[0], to])[np.searchsorted(begin, ends)]
        for i, low, high in zip(rows, [0, *cuts[:-1].tolist()], cuts.tolist()):
            out[i].append(ids[low:high].tobytes())


@lru_cache(maxsize=1)
def encoder(path: str) -> _Encoder:
    return _Encoder(path)


def tokenise(docs: DataFrame, vocabulary: str | None = None, end: int = END) -> DataFrame:
    """(doc_id, tie, n_tokens, ids): ids as little-endian uint16 with the end id; tie orders rows of one id."""
    lighter_batches(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    last = np.array([end], dtype="<u2").tobytes()

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for b in small_batches(got):
            ids = [x + last for x in own.texts([t or "" for t in b.column(2).to_pylist()])]
            n = pa.array([len(x) // 2 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n, pa.array(ids, pa.binary())], ["doc_id", "tie", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text").mapInArrow(run, "doc_id long, tie long, n_tokens long, ids binary")


def count_ids(tokens: DataFrame) -> np.ndarray:
    """Uses of each id over the whole table: at most one row for each id of the vocabulary reaches the driver."""

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, dtype=np.int64)
        for b in got:
            total += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), dtype="<u2"), minlength=1 << 16)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(1 << 16, dtype=np.int64)
    for r in rows:
        out[r["id"]] = r["n"]
    return out


def _ranges(tokens: DataFrame, range_ids: int) -> tuple[np.ndarray, list[int]]:
    """First doc_id of each range of about range_ids ids after the first, and the ids before each range."""
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    n = max(int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total // range_ids))
    at = [i / n for i in range(1, n)]
    cuts = tokens.where("doc_id is not null").approxQuantile("doc_id", at, 0.1 / n) if total and n > 1 else []
    splits = np.unique(np.array(cuts, dtype=np.int64))
    sums = {r["range"]: r["n"] for r in tokens.withColumn("range", _range_of(splits)).groupBy("range").agg(F.sum("n_tokens").alias("n")).collect()}
    before, out = 0, []
    for k in range(len(splits) + 1):
        out.append(before)
        before += sums.get(k, 0)
    return splits, out


def _range_of(splits: np.ndarray):
    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        out = np.searchsorted(splits, ids.fillna(0).to_numpy(np.int64), side="right")
        return pd.Series(np.where(ids.isna(), 0, out).astype(np.int32))

    return place(F.col("doc_id"))


BLOCK = "start long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, checkpoints array<long>, payload binary"


def write(docs: DataFrame, path: str, vocabulary: str | None = None, block_ids: int = BLOCK_IDS, range_ids: int = RANGE_IDS) -> str:
    """Write the ids of docs under path: path/blocks and path/lengths, in ascending doc_id order. Returns path."""
    spark = docs.sparkSession
    tokens = materialise(tokenise(docs, vocabulary), "token-ids")
    lengths = code_lengths(count_ids(tokens))
    splits, before = _ranges(tokens, range_ids)
    sent = spark.sparkContext.broadcast((lengths, canonical_codes(lengths), before))

    def pack(start: int, docs: list[tuple[int | None, bytes]]) -> pa.RecordBatch:
        lengths, codes, _ = sent.value
        ids = np.frombuffer(b"".join(x for _, x in docs), dtype="<u2")
        payload, checkpoints = encode(ids, lengths, codes)
        longs = pa.list_(pa.int64())
        columns = [pa.array([start]), pa.array([len(ids)]), pa.array([[i for i, _ in docs]], longs), pa.array([[len(x) // 2 for _, x in docs]], longs)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([checkpoints.tolist()], longs), pa.array([payload], pa.binary())], BLOCK.replace(" long", "").replace(" array<long>", "").replace(" binary", "").split(", "))

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now, held, n = 0, None, [], 0
        for b in got:
            for k, doc_id, ids in zip(*(b.column(c).to_pylist() for c in range(3))):
                if k != now or n >= block_ids:
                    if held:
                        yield pack(at, held)
                    at = sent.value[2][k] if k != now else at + n
                    now, held, n = k, [], 0
                held.append((doc_id, ids))
                n += len(ids) // 2
        if held:
            yield pack(at, held)

    ordered = tokens.withColumn("range", _range_of(splits)).repartitionByRange(len(splits) + 1, "range").sortWithinPartitions("range", F.asc_nulls_first("doc_id"), "tie")
    ordered.select("range", "doc_id", "ids").mapInArrow(run, BLOCK).write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([(lengths.tobytes(),)], "lengths binary").coalesce(1).write.parquet(f"{path}/lengths")
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files under path; ids as little-endian uint32."""
    lengths = np.frombuffer(spark.read.parquet(f"{path}/lengths").first()[0], dtype=np.uint8)
    sent = spark.sparkContext.broadcast(lengths)

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(sent.value)
        for b in got:
            for block in b.to_pylist():
                ids = decoder.decode(block["payload"], np.array(block["checkpoints"], dtype=np.int64), block["n_tokens"]).astype("<u4")
                n = np.array(block["doc_tokens"], dtype=np.int64)
                starts = np.cumsum(n) - n
                own = [ids[s : s + k].tobytes() for s, k in zip(starts.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(block["doc_ids"], pa.int64()), pa.array(starts + block["start"]), pa.array(n), pa.array(own, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return spark.read.schema(BLOCK).parquet(f"{path}/blocks").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the files that write() makes of docs, read back."""
    spark = docs.sparkSession
    back = read(spark, write(docs, f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}", **options))

    def digest(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in got:
            sums = pa.array([zlib.crc32(x) for x in b.column(3).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], sums], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return back.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
