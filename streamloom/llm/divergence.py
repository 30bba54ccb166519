"""How the sources of a language differ from each other and from the language, by exact arithmetic on term counts.

A language keeps the terms that enough of its documents hold. A group is the part of a language from one source; it and
the language as a whole give a kept term of count c the weight p = 1 + UNIT * (c + 2) // (N + 2 V), so p depends on the
group and the count alone: a count is a level. The divergence of two groups sums a price f(p, q) over all kept terms. In
a block of terms every group's levels are indicator columns, one for each distinct count; a block's columns multiplied by
their transpose hold, for every two groups and levels, the number of terms at both: the joint tables. Each table is
priced where it is made, and the prices of all blocks are summed. Indicators are 0 or 1 and blocks below 2^24 terms, so
that the products in single precision are exact; weights are computed as whole numbers of any size.

Terms are counted in each task and combined in Spark by (lang, term); a term's row holds its counts by source, at most
one a source. Blocks are dealt by a hash of the term, so a common term is one row like any other, and a hot source is
spread over all blocks. A task holds one block of BLOCK_TERMS terms or CELLS counts.

Defined cases: a null text, language or source is the empty one; an empty text or one without a term still makes its
group known; a language without kept terms gives 0 for each pair; a language of one source has no pairs; repeated rows
count each time; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lighter_batches, materialise, small_batches

UNIT = 1_000_000_000
LEAST_DOCS, TOP = 10, 10
#: Terms of a block, the counts that it may have in all groups together, and the indicator columns multiplied at once.
BLOCK_TERMS, CELLS, TILE = 2048, 1 << 22, 512
#: Terms that a task counts before it hands its counts on.
HELD_TERMS = 200_000
#: Bytes of terms: letters of A-Z lower-cased and all that is not ASCII; others become spaces.
_BYTES = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Bytes of a text that are split at once.
SPLIT_AT_ONCE = 1 << 22


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in order, some at a time."""
    data = text.encode().translate(_BYTES)
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > SPLIT_AT_ONCE:
            cut = data.rfind(b" ", at, at + SPLIT_AT_ONCE)
            cut = cut if cut >= 0 else data.find(b" ", at + SPLIT_AT_ONCE)
            end = cut if cut >= 0 else end
        yield data[at:end].split()
        at = end + 1


COUNTS = "lang string, source string, term string, n long, docs long"


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group and the group's documents that hold it. A row with an empty term stands for the group itself and counts its documents."""
    lighter_batches(docs.sparkSession)

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in held.items():
                keys = list(n)
                for at in range(0, len(keys), 1 << 16):
                    some = keys[at : at + (1 << 16)]
                    columns = [pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array([k.decode() for k in some])]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([n[k] for k in some]), pa.array([d[k] for k in some])], ["lang", "source", "term", "n", "docs"])

        for b in small_batches(got):
            for text, lang, source in zip(*(c.to_pylist() for c in b.columns)):
                n, d = held.setdefault((lang or "", source or ""), (Counter(), Counter()))
                n[b""] += 0
                d[b""] += 1
                own = Counter()
                for some in terms_of(text or ""):
                    own.update(some)
                n.update(own)
                d.update(own.keys())
            if sum(len(n) for n, _ in held.values()) > HELD_TERMS:
                yield from rows()
                held.clear()
        yield from rows()

    each = docs.select("text", "lang", "source").mapInArrow(run, COUNTS)
    # one exchange serves the counts of groups and those of languages
    return each.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least_docs: int) -> DataFrame:
    """(lang, term, sources, ns): the terms that enough documents of their language hold, with their counts by source."""
    by_term = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("_c"))
    return by_term.where(F.col("docs") >= least_docs).select("lang", "term", F.col("_c.source").alias("sources"), F.col("_c.n").alias("ns"))


def weights(levels: np.ndarray, total: int, n_terms: int, unit: int) -> np.ndarray:
    """p of each count: whole numbers of any size in between, below 2^31 or so at the end."""
    return np.array([1 + unit * (int(c) + 2) // (total + 2 * n_terms) for c in levels], dtype=np.int64)


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def joint_prices(counts: np.ndarray, totals: list[int], n_terms: int, unit: int = UNIT, tile: int = TILE) -> Iterator[tuple[int, int, int]]:
    """(i, j, price of their joint table) for groups i < j over a block's counts (terms x groups).

    A group's columns come in tiles of at most so many levels; tiles of several groups are one product where they fit.
    """
    columns: list[tuple[int, np.ndarray, np.ndarray]] = []  # (group, its level of each term, weights of the levels), cut to tiles
    for g in range(counts.shape[1]):
        levels, at = np.unique(counts[:, g], return_inverse=True)
        p = weights(levels, totals[g], n_terms, unit)
        for low in range(0, len(levels), tile):
            columns.append((g, np.where((at >= low) & (at < low + tile), at - low, -1), p[low : low + tile]))
    tiles: list[list[int]] = []
    for k, (_, _, p) in enumerate(columns):
        if not tiles or sum(len(columns[x][2]) for x in tiles[-1]) + len(p) > tile:
            tiles.append([])
        tiles[-1].append(k)

    def indicators(own: list[int]) -> tuple[np.ndarray, np.ndarray]:
        starts = np.cumsum([0, *(len(columns[k][2]) for k in own)])
        out = np.zeros((counts.shape[0], starts[-1]), dtype=np.float32)
        for k, start in zip(own, starts):
            at = columns[k][1]
            out[np.flatnonzero(at >= 0), start + at[at >= 0]] = 1
        return out, starts

    for a, left in enumerate(tiles):
        x, at_x = indicators(left)
        for right in tiles[a:]:
            y, at_y = (x, at_x) if right is left else indicators(right)
            joint = (x.T @ y).astype(np.int64)
            for i, k in enumerate(left):
                for j, m in enumerate(right):
                    (g, _, p), (h, _, q) = columns[k], columns[m]
                    if g < h:
                        table = joint[at_x[i] : at_x[i + 1], at_y[j] : at_y[j + 1]]
                        u, v = np.nonzero(table)
                        yield g, h, int((table[u, v] * price(p[u], q[v])).sum())


def top_terms(terms: np.ndarray, counts: np.ndarray, totals: list[int], n_terms: int, unit: int, top: int) -> Iterator[tuple[int, int, int]]:
    """(group, place of the term, price) of the terms that stand out most in each group of a block, against the language. terms ascend."""
    levels, at = np.unique(counts.sum(1), return_inverse=True)
    q = weights(levels, sum(totals), n_terms, unit)[at]
    for g in range(counts.shape[1]):
        levels, at = np.unique(counts[:, g], return_inverse=True)
        p = weights(levels, totals[g], n_terms, unit)[at]
        own = np.flatnonzero((counts[:, g] > 0) & (p > q))
        value = price(p[own], q[own])
        for k in np.argsort(-value, kind="stable")[:top]:
            yield g, int(own[k]), int(value[k])


PRICED = "lang string, source string, part string, item string, value long"


def price_blocks(rows: DataFrame, unit: int, top: int) -> DataFrame:
    """(lang, source, part, item, value) of each block of rows (lang, block, head, term, sources, ns), in order of its head: first the language's sources with their sums and the number of kept terms, then the terms."""

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, totals, n_terms, held = None, [], [], 0, []

        def priced() -> Iterator[pa.RecordBatch]:
            place = {s: i for i, s in enumerate(names)}
            held.sort(key=lambda t: t[0])
            counts = np.zeros((len(held), len(names)), dtype=np.int64)
            for i, (_, sources, ns) in enumerate(held):
                counts[i, [place[s] for s in sources]] = ns
            out = [(names[g], "pair", names[h], v) for g, h, v in joint_prices(counts, totals, n_terms, unit)]
            out += [(names[g], "term", held[k][0].decode(), v) for g, k, v in top_terms(np.arange(len(held)), counts, totals, n_terms, unit, top)]
            for at in range(0, len(out), 1 << 16):
                some = list(zip(*out[at : at + (1 << 16)]))
                yield pa.RecordBatch.from_arrays([pa.array([now[0]] * len(some[0])), *map(pa.array, some)], ["lang", "source", "part", "item", "value"])
            held.clear()

        for b in got:
            for lang, block, head, term, sources, ns in zip(*(c.to_pylist() for c in b.columns)):
                if held and ((lang, block) != now or len(held) >= BLOCK_TERMS or (len(held) + 1) * len(names) > CELLS):
                    yield from priced()
                if head:
                    now, names, totals, n_terms = (lang, block), sources, ns[1:], ns[0]
                else:
                    held.append((term.encode(), sources, ns))
        if held:
            yield from priced()

    return rows.select("lang", "block", "head", "term", "sources", "ns").mapInArrow(run, PRICED)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, unit: int = UNIT) -> DataFrame:
    """(lang, source, part, item, value, rank): every other source of the language by divergence (part 'pair'), and the top terms of each source against its language (part 'term')."""
    counts = materialise(count_terms(docs), "divergence-counts")
    kept = materialise(kept_terms(counts, least_docs), "divergence-terms")
    groups = counts.where("term = ''").select("lang", "source")
    sums = kept.select("lang", F.explode(F.arrays_zip("sources", "ns")).alias("_c")).groupBy("lang", F.col("_c.sources").alias("source")).agg(F.sum("_c.ns").alias("n"))
    groups = materialise(groups.join(sums, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n")), "divergence-groups")
    # a row for each language: its number of kept terms, then its groups' sums
    own = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("_g"))
    # written, so that its size is known: Spark sends it to the terms while it is small, and splits languages beyond
    langs = materialise(own.join(kept.groupBy("lang").agg(F.count("*").alias("v")), "lang"), "divergence-langs")
    n_blocks = F.ceil(F.col("v") / BLOCK_TERMS).cast("int")
    heads = langs.select(
        "lang", F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("block"), F.lit(True).alias("head"), F.lit("").alias("term"),
        F.col("_g.source").alias("sources"), F.concat(F.array("v"), F.col("_g.n")).alias("ns"),
    )
    numbered = kept.join(langs.select("lang", n_blocks.alias("_n")), "lang")
    dealt = numbered.select("lang", F.pmod(F.xxhash64("term"), F.col("_n")).cast("int").alias("block"), F.lit(False).alias("head"), "term", "sources", "ns")
    rows = heads.unionByName(dealt).repartition("lang", "block").sortWithinPartitions("lang", "block", F.desc("head"))
    priced = materialise(price_blocks(rows, unit, top), "divergence-prices")
    one_way = priced.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = one_way.unionByName(one_way.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    every = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = every.join(both, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    terms = priced.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)
