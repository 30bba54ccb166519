"""Canonical length-limited Huffman coding of token ids, in independent blocks with bit-offset checkpoints.

Code lengths come from global counts by package-merge, at most MAX_BITS each, so that decoding is a lookup of the next
MAX_BITS bits. Canonical codes follow from the lengths alone. A block's payload is its ids' codes, most significant bit
first; every STRIDE ids a checkpoint gives the bit offset, and all stretches between checkpoints decode side by side.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np

MAX_BITS, STRIDE = 16, 256


def code_lengths(counts: Sequence[int] | np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths under max_bits (0 for ids that never occur), by package-merge."""
    counts = np.asarray(counts, dtype=np.int64)
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} ids can't have codes of {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    coins = counts[order].tolist()
    # each level: packages of pairs from the level below, merged with the coins; only which entries are packages is kept
    levels: list[list[bool]] = []
    packages: list[int] = []
    for _ in range(max_bits):
        merged = list(heapq.merge(((c, False) for c in coins), ((p, True) for p in packages)))
        levels.append([is_package for _, is_package in merged])
        packages = [merged[i][0] + merged[i + 1][0] for i in range(0, len(merged) - 1, 2)]
    take, lengths = 2 * len(coins) - 2, np.zeros(len(coins), dtype=np.uint8)
    for level in reversed(levels):
        n_packages = sum(level[:take])
        lengths[: take - n_packages] += 1
        take = 2 * n_packages
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), dtype=np.uint32)
    code, last = 0, 0
    used = np.flatnonzero(lengths)
    for i in used[np.lexsort((used, lengths[used]))]:
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def encode(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Payload and the bit offset of every STRIDE-th id."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    starts = ends - n
    total = int(ends[-1]) if len(ends) else 0
    out = np.zeros(total // 8 + 4, dtype=np.uint8)
    word = codes[ids] << (24 - n - (starts & 7)).astype(np.uint32)  # at most 16 + 7 bits in three bytes
    at = starts >> 3
    for k, shift in enumerate((16, 8, 0)):
        np.add.at(out, at + k, ((word >> np.uint32(shift)) & np.uint32(255)).astype(np.uint8))
    return out[: (total + 7) // 8].tobytes(), starts[::STRIDE]


class Decoder:
    """Table-driven decoder for one set of code lengths."""

    def __init__(self, lengths: np.ndarray):
        codes = canonical_codes(lengths)
        self.ids = np.zeros(1 << MAX_BITS, dtype=np.uint32)
        self.bits = np.ones(1 << MAX_BITS, dtype=np.uint8)
        for i in np.flatnonzero(lengths):
            low = int(codes[i]) << (MAX_BITS - int(lengths[i]))
            high = low + (1 << (MAX_BITS - int(lengths[i])))
            self.ids[low:high] = i
            self.bits[low:high] = lengths[i]

    def decode(self, payload: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """The n ids of a block: a step decodes one id of every stretch."""
        data = np.zeros(len(payload) + 4, dtype=np.uint32)
        data[: len(payload)] = np.frombuffer(payload, dtype=np.uint8)
        window = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
        out = np.zeros((STRIDE, len(checkpoints)), dtype=np.uint32)
        at = np.array(checkpoints, dtype=np.int64)
        rest = n - STRIDE * (len(checkpoints) - 1) if len(checkpoints) else 0
        for k in range(min(STRIDE, n)):
            if k == rest:  # the last stretch is shorter
                at = at[:-1]
            peek = (window[at >> 3] >> (24 - MAX_BITS - (at & 7)).astype(np.uint32)) & np.uint32((1 << MAX_BITS) - 1)
            out[k, : len(at)] = self.ids[peek]
            at = at + self.bits[peek]
        return out.T.reshape(-1)[:n]
