"""Byte-level BPE by ranks: exact encoding in linear time, and decoding.

Each match of the pattern is encoded by itself. Its bytes are read as Latin-1, so that an Aho-Corasick automaton over the
vocabulary finds the longest token from any place. Tokens are laid from left to right, the longest first; a token may
follow another only if merging by ranks leaves the two as they are, and where none may, the last token is taken back and
the place is closed for good: any row of tokens in which all neighbours agree is the one that the merges make of its
bytes, so each prefix has one row only and no place is entered twice. Whether two tokens agree is worked out once, along the
edges of their merge trees, and remembered.

Defined cases: a null text is the empty text, which has no ids; a text of any length is split in passing, and a match of
any length takes time in proportion to it; rows of repeated or null ids are rows of their own; other columns are carried
along, those named like an output are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from math import inf

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lighter_batches, small_batches, without

#: Matches and pairs of tokens that a process remembers, and the longest match among them in bytes.
HELD_PARTS, HELD_PAIRS, HELD_BYTES = 300_000, 500_000, 64
#: Characters of a text that is split at once; a longer one is split in passing.
SPLIT_AT_ONCE = 1 << 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    """Token -> rank of a file with a base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class BytePairs:
    """A vocabulary of byte strings with ranks; every single byte must be a token."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("not every byte is a token")
        self.ranks = ranks
        self.tokens: dict[int, bytes] = {r: t for t, r in ranks.items()}
        self.length = {r: len(t) for t, r in ranks.items()}
        reach = max(self.length.values())
        automaton = ahocorasick.Automaton()
        for t, r in ranks.items():
            automaton.add_word(t.decode("latin-1"), r)
        automaton.make_automaton()
        #: The longest token from a place of a text; a search takes time for all that it is given.
        self.longest = lambda text, at: next(automaton.iter_long(text[at : at + reach]))[1]
        #: The next shorter token that a token begins with.
        self.shorter = {r: next((ranks[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in ranks), None) for t, r in ranks.items()}
        self._agree: dict[tuple[int, int], bool] = {}
        self._edges: dict[int, tuple] = {}

    def merged(self, data: bytes, until: int = 1) -> list[bytes]:
        """data after the merges, the lowest rank first, of equal ones the leftmost, or while more than so many parts are left. For short data: quadratic."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > until:
            joined = [self.ranks.get(a + b) for a, b in zip(parts, parts[1:])]
            least = min((r for r in joined if r is not None), default=None)
            if least is None:
                break
            at = joined.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def edges(self, token: int) -> tuple[list[tuple[bytes, float]], list[tuple[bytes, float]]]:
        """What stands at the token's left end, and at its right end, while its merges go on: from a byte to the whole, each with the rank of the merge that takes it in."""
        known = self._edges.get(token)
        if known is None:
            data = self.tokens[token]
            if len(data) == 1:
                known = [(data, inf)], [(data, inf)]
            else:
                parts = self.merged(data, 2)
                halves = [self.ranks.get(p, inf) for p in parts]
                if len(parts) != 2 or max(halves) >= token:
                    raise ValueError(f"token {token} is not made of tokens of lower ranks")
                (left, _), (_, right) = (self.edges(h) for h in halves)
                known = [*left[:-1], (parts[0], token), (data, inf)], [*right[:-1], (parts[1], token), (data, inf)]
            self._edges[token] = known
        return known

    def agree(self, left: int, right: int) -> bool:
        """Whether the merges leave the two tokens apart, and whole, where they stand side by side.

        Ranks grow from a token's parts to the token, so at any time the place between the two has one of left's right
        edges before it and one of right's left edges behind it. The two agree if none of these pairs is a token whose
        rank comes before the merges that take its parts in; of equal ranks the merge to the left comes first.
        """
        pair = (left, right)
        known = self._agree.get(pair)
        if known is None:
            if len(self._agree) >= HELD_PAIRS:
                self._agree.clear()
            known = self._agree[pair] = self._stay_apart(self.edges(left)[1], self.edges(right)[0])
        return known

    def _stay_apart(self, before: list[tuple[bytes, float]], behind: list[tuple[bytes, float]]) -> bool:
        i = j = 0
        while True:
            (a, until_a), (b, until_b) = before[i], behind[j]
            across = self.ranks.get(a + b, inf)
            if across < until_a and across <= until_b and across < inf:
                return False
            if until_a == until_b == inf:
                return True
            if until_a <= until_b:
                i += 1
            else:
                j += 1

    def encode(self, data: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(data)
        if whole is not None or not data:
            return [whole] if data else []
        text, n = data.decode("latin-1"), len(data)
        out: list[int] = []
        closed = bytearray(n + 1)
        at, token = 0, self.longest(text, 0)
        while True:
            end = at + self.length[token]
            if not closed[end] and (not out or self.agree(out[-1], token)):
                out.append(token)
                if end == n:
                    return out
                at, token = end, self.longest(text, end)
                continue
            less = self.shorter[token]
            while less is None:  # nothing may begin here: the token before gives way
                closed[at] = 1
                token = out.pop()
                at -= self.length[token]
                less = self.shorter[token]
            token = less

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Encoder(dict):
    """Match of the pattern -> its ids as bytes (little-endian uint32); the short ones used of late are kept."""

    def __init__(self, path: str, pattern: str):
        self.pairs = BytePairs(read_ranks(path))
        self.pattern = regex.compile(pattern)
        self.older: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        out = self.older.get(part)
        if out is None:
            data = part.encode()
            ids = self.pairs.encode(data)
            out = struct.pack(f"<{len(ids)}I", *ids)
            if len(data) > HELD_BYTES:
                return out
        if len(self) >= HELD_PARTS:
            self.older = dict(self)
            self.clear()
        self[part] = out
        return out

    def text(self, text: str) -> bytes:
        if len(text) <= SPLIT_AT_ONCE:
            return b"".join(map(self.__getitem__, self.pattern.findall(text)))
        out, found = [], self.pattern.finditer(text)
        while own := [self[m.group()] for m in islice(found, 1 << 16)]:
            out.append(b"".join(own))
        return b"".join(out)


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs with ids: those of the text as little-endian unsigned 32-bit integers. Nothing is shuffled."""
    lighter_batches(docs.sparkSession)
    kept, own = without(docs, "ids"), (vocabulary or default_vocabulary(), pattern or default_pattern())
    at = kept.columns.index("text")

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder(*own).text
        for b in small_batches(got, 128):
            ids = pa.array([to_ids(t) if t else b"" for t in b.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, ids], [*b.schema.names, "ids"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("ids", T.BinaryType())]))


def decode(encoded: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """encoded with decoded: the bytes that its column ids stands for; null where ids is null. An id outside the vocabulary raises."""
    kept, own = without(encoded, "decoded"), (vocabulary or default_vocabulary(), pattern or default_pattern())
    at = kept.columns.index("ids")

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_bytes = encoder(*own).pairs.decode
        for b in small_batches(got, 128):
            made = pa.array([None if x is None else to_bytes(np.frombuffer(x, dtype="<u4").tolist()) for x in b.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, made], [*b.schema.names, "decoded"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("decoded", T.BinaryType())]))


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of docs, encoded and decoded again."""
    encoded = encode(docs.select("doc_id", "text")).select("doc_id", "ids")
    n = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return decode(encoded).select("doc_id", n, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
