"""Keep-if-far-enough over sorted keys: what cooldowns and windowed deduplication have in common.

An item is kept if it is the first of its key or lies at least a gap after the last kept one. That is recursive over the
kept items, so no window function gives it. It goes in two passes. A key is first dealt over tasks by stretches of time of
STRETCH gaps. What was kept before a stretch is not known there, but an item of it is kept only if it lies within the
first gap, where the stretch may be entered, or if it is the next one a gap after an item that may be kept itself. All
others go at once: of a dense key a small part stays, as chains that start apart soon meet. The second pass takes the rest
of a key in order, holding the time kept last. So a hot key is sorted and thinned in many tasks; what passes through one
is about what is kept, times the chains that never meet, or a stretch's first gap of each STRETCH.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Gaps of a stretch: more of them thin better, fewer spread a key over more tasks.
STRETCH = 16
_OWN = ("_gap", "_stretch")


class Chains:
    """The items of a stretch that may be kept, times ascending, a part of the stretch at a time."""

    def __init__(self, first: int, gap: int):
        self.gap, self.entry = gap, first + gap
        self.ends = np.zeros(0, dtype=np.int64)  # last items of the chains so far

    def take(self, times: np.ndarray) -> np.ndarray:
        """Which of the next times may be kept."""
        if self.gap <= 0:
            return np.ones(len(times), dtype=bool)
        keep = times < self.entry
        ends = np.union1d(self.ends, times[keep])
        rest: list[np.ndarray] = []
        while len(ends):
            at = np.searchsorted(times, ends + self.gap)
            inside = at < len(times)
            rest.append(ends[~inside])
            hit = np.unique(at[inside])
            hit = hit[~keep[hit]]  # the chain of one that is kept already has been followed
            keep[hit] = True
            ends = times[hit]
        self.ends = np.unique(np.concatenate(rest)) if rest else ends
        return keep


def _runs(columns: list[pa.Array]) -> np.ndarray:
    """Where the rows' values differ from those of the row before, and the end."""
    n = len(columns[0])
    if n == 0:
        return np.zeros(1, dtype=np.int64)
    differs = np.zeros(n - 1, dtype=bool)
    for c in columns:
        a, b = c.slice(0, n - 1), c.slice(1)
        same = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False)
        both = np.logical_and(pc.is_null(a).to_numpy(zero_copy_only=False), pc.is_null(b).to_numpy(zero_copy_only=False))
        differs |= ~(same | both)
    return np.concatenate([[0], np.flatnonzero(differs) + 1, [n]])


def keep_spaced(items: DataFrame, keys: list[str], at: str, gap: Column, tie: str) -> DataFrame:
    """items less those nearer than gap (in units of at) after the last kept item of their keys, in order of (at, tie).

    A key's items share one gap. Repeated items are items of their own: with a gap over zero, one of them is kept. Nulls of
    tie come first; a null key is a key; items without a time or a gap are left out; all other columns are carried along.
    """
    given = items.withColumn("_gap", gap.cast("long")).where(F.col(at).isNotNull() & F.col("_gap").isNotNull())
    stretch = F.when(F.col("_gap") > 0, F.floor(F.col(at) / (F.col("_gap") * STRETCH))).otherwise(F.lit(0)).cast("long")
    dealt = given.withColumn("_stretch", stretch)
    names, wanted = dealt.columns, items.columns
    key_places = [names.index(c) for c in keys]
    at_place, gap_place, stretch_place = (names.index(c) for c in (at, *_OWN))

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chains = None, None
        for b in batches:
            cuts = _runs([b.column(p) for p in (*key_places, stretch_place)])
            times, gaps = b.column(at_place).to_numpy(), b.column(gap_place).to_numpy()
            keep = np.ones(b.num_rows, dtype=bool)
            for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if low == 0 or high == b.num_rows:  # only these may go on in another batch
                    own = tuple(b.column(p)[low].as_py() for p in (*key_places, stretch_place))
                    if own != now:
                        now, chains = own, Chains(int(times[low]), int(gaps[low]))
                elif high - low == 1:
                    continue
                else:
                    chains = Chains(int(times[low]), int(gaps[low]))
                keep[low:high] = chains.take(times[low:high])
            yield b.filter(pa.array(keep))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for b in batches:
            keep = []
            for key, t, least in zip(zip(*[b.column(p).to_pylist() for p in key_places]), b.column(at_place).to_pylist(), b.column(gap_place).to_pylist()):
                ok = key != now or t - last >= least
                if ok:
                    now, last = key, t
                keep.append(ok)
            yield b.filter(pa.array(keep, pa.bool_())).select(wanted)

    thinned = dealt.repartition(*keys, "_stretch").sortWithinPartitions(*keys, "_stretch", at, tie).mapInArrow(thin, dealt.schema)
    return thinned.repartition(*keys).sortWithinPartitions(*keys, at, tie).mapInArrow(choose, items.schema)
