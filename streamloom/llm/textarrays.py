"""Texts of a batch as flat numpy arrays: code points, words, and position-independent hashes of any span.

Words are maximal runs of characters of chosen Unicode classes in the lower-cased text. The hash of a span is a
polynomial in its code points modulo 2^64, read off prefix sums, so that hashing every word, shingle or substring of a
batch takes a few vector operations.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import regex

BASE = np.uint64(0x9E3779B97F4A7C15)
CHARS_AT_ONCE = 1 << 20
#: Characters of a batch, unless a caller wants other ones: smaller ones take less memory.
BATCH_CHARS = 1 << 18
_LAST_GAP, _NEXT_GAP = regex.compile(r"(?r)[^\p{L}\p{M}\p{N}]"), regex.compile(r"[^\p{L}\p{M}\p{N}]")
#: Coefficients of the words of a shingle.
STEPS = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(16)], dtype=np.uint64)


@lru_cache(maxsize=4)
def char_class(kinds: str) -> np.ndarray:
    """For each code point whether its general category starts with one of kinds."""
    return np.array([unicodedata.category(chr(c))[0] in kinds for c in range(0x110000)], dtype=bool)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers_of(CHARS_AT_ONCE + 2)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i below n at least; those of a longer string are not kept."""
    return _powers() if n <= CHARS_AT_ONCE + 2 else _powers_of(n)


def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    def up(x: int) -> np.ndarray:
        out = np.ones(n, dtype=np.uint64)
        out[1:] = np.uint64(x)
        return np.multiply.accumulate(out)

    return up(int(BASE)), up(pow(int(BASE), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Chars:
    """Code points of a string and the hashes of its spans; some 50 bytes a character."""

    def __init__(self, text: str):
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        up, self.down = powers(len(self.codes) + 2)
        self.sums = np.zeros(len(self.codes) + 1, dtype=np.uint64)
        np.cumsum((self.codes.astype(np.uint64) + np.uint64(1)) * up[: len(self.codes)], out=self.sums[1:])

    def words(self, kinds: str) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of characters of these kinds."""
        inside = np.zeros(len(self.codes) + 2, dtype=np.int8)
        inside[1:-1] = char_class(kinds)[self.codes]
        turn = np.diff(inside)
        return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Polynomial hash of each span: the same wherever the span stands."""
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]


def span_hash(text: str) -> int:
    """The hash that Chars gives a span, of one string."""
    if len(text) > 64:
        chars = Chars(text)
        return int(chars.hashes(np.array([0]), np.array([len(chars.codes)]))[0])
    out, p = 0, 1
    for c in text:
        out += (ord(c) + 1) * p
        p = p * int(BASE) & 0xFFFFFFFFFFFFFFFF
    return out & 0xFFFFFFFFFFFFFFFF


def pieces(text: str, size: int = CHARS_AT_ONCE) -> Iterator[str]:
    """text in pieces of about size characters, cut where no word is: after any character that is neither letter, mark nor
    number. Only a word longer than that makes a longer piece, which ends with it."""
    at = 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            for low in range(end, at, -4096):  # look back for the end of a word
                m = _LAST_GAP.search(text, max(at, low - 4096), low)
                if m:
                    end = m.end()
                    break
            else:
                m = _NEXT_GAP.search(text, end)
                end = m.end() if m else len(text)
        yield text[at:end]
        at = end


def batches(texts: list[str | None], size: int = BATCH_CHARS) -> Iterator[tuple[Chars, list[int], np.ndarray]]:
    """Lower-cased texts joined by line feeds into Chars, with each part's row and its start. A long text has several parts, all of one row."""
    rows: list[int] = []
    parts: list[str] = []
    n = 0

    def full() -> tuple[Chars, list[int], np.ndarray]:
        starts = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])[:-1]]).astype(np.int64)
        return Chars("\n".join(parts)), rows, starts

    for i, t in enumerate(texts):
        for p in pieces((t or "").lower(), size - 1):
            if parts and n + len(p) + 1 > size:
                yield full()
                rows, parts, n = [], [], 0
            rows.append(i)
            parts.append(p)
            n += len(p) + 1
    if parts:
        yield full()
