"""Near copies by exact Jaccard similarity of five-word shingles, with SimHash fingerprints as the first search.

Texts link where the sets of five-word shingles of their lower-cased words have a Jaccard similarity of 0.8 or more; a
component is what is reachable over links. Fingerprints alone can't decide this: at a similarity of 0.8 they differ in
about 10 of 64 bits, with a wide spread, and pigeonhole blocks for that many bits agree in two or three bits only. So the
Gray-order index of simhash gives the links of at most three bits, and a second search finds those that it cannot.

Second search: in one total order of all shingles, two sets of similarity 0.8 share one of their first n // 5 + 1
shingles, n being a set's size. The order puts shingles that texts of one task share last, by their number, the others by hash; any order
finds every pair, this one keeps the lists of texts by shingle short. Every list first meets its least text; those pairs
that share enough first shingles are verified, with the index's, and joined to components; in lists of many components some
more texts do the same. What is left are pairs of different components that share a list at places where the first shared
shingle of an alike pair can stand. So a large group of copies of one text is not compared pairwise, and no pair is left
out.

Pairs are verified by their texts only where their numbers of shingles, of shared first ones and of differing bits of
their bitmaps (each set in SIGN_BITS bits) allow a similarity of 0.8 at all; none of these bounds rejects a true pair.

Defined cases: texts of equal sets are one node, null and blank texts being of the empty set; a text under five words is
one shingle of its words; of each component one row stays, that of the smallest doc_id, or any one where none has an id;
an empty table stays empty; other columns are carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lighter_batches, materialise, small_batches
from .components import components
from .simhash import SEED, TABLES, bit_counts, forest, word_pieces
from .textarrays import STEPS, mixed

WORDS = 5
#: The least similarity, as a fraction.
PART, WHOLE = 4, 5
#: Shingles counted at a time in a task, and the most of the common ones that the order knows.
COUNTED, MAX_COMMON = 1 << 22, 1 << 19
SIGN_BITS = 1024
#: Texts of a list of more than CROWD components that meet all others of it, and how often before the rest is paired.
CROWD, PIVOTS, PIVOT_ROUNDS = 8, 12, 1
#: Shingles of verified texts that a task keeps for their next pairs.
HELD_SHINGLES = 1 << 20
#: Rows of at most 24 bytes up to which a set of rows is broadcast (64 MB); a merge join beyond.
BROADCAST_ROWS = 2_500_000


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    digest = xxhash.xxh64_intdigest
    pieces = word_pieces((text or "").lower().encode("utf-8", "surrogatepass"))
    words = np.concatenate([np.zeros(0, dtype=np.uint64), *[np.fromiter(map(digest, p), dtype=np.uint64, count=len(p)) for p in pieces]])
    n = min(WORDS, len(words))
    if not n:
        return words
    m = len(words) - n + 1
    total = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        total += words[k : k + m] * STEPS[k]
    return np.unique(mixed(total))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return WHOLE * both >= PART * (len(a) + len(b) - both)


def bitmap(own: np.ndarray) -> bytes:
    """A set's bits: each shingle sets one."""
    bits = np.zeros(SIGN_BITS, dtype=bool)
    bits[own & np.uint64(SIGN_BITS - 1)] = True
    return np.packbits(bits).tobytes()


def fingerprint(own: np.ndarray) -> int:
    """SimHash of a set of shingle hashes as a signed number."""
    return int(np.packbits(bit_counts(own) * 2 > len(own), bitorder="little").view(np.int64)[0])


def prefix(own: np.ndarray, common: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The first shingles of a set: n - ceil(0.8 n) + 1 of its n. common are sorted hashes, place their places in the order."""
    k = len(own) - -(-PART * len(own) // WHOLE) + 1 if len(own) else 0
    if not len(common):
        return own[:k]
    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
    known = common[at] == own
    late = own[known][np.argsort(place[at[known]])]
    return np.concatenate([own[~known], late])[:k]


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The MAX_COMMON shingles at most that come most often among those that several texts of one task share, sorted, and the place of each by its number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keys, size = [], set(), 0

        def repeated() -> pa.RecordBatch:
            hashes, n = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *held]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(hashes[n > 1].view(np.int64)), pa.array(n[n > 1])], ["h", "n"])

        for b in small_batches(batches):
            for t in b.column(0).to_pylist():
                own = shingle_set(t)
                key = xxhash.xxh64_intdigest(own.tobytes(), SEED)
                if key not in keys:  # of equal texts one counts
                    keys.add(key)
                    held.append(own)
                    size += len(own)
                if size > COUNTED:
                    yield repeated()
                    held, keys, size = [], set(), 0
        yield repeated()

    counted = docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    got = counted.orderBy(F.desc("n"), "h").limit(MAX_COMMON).toArrow()
    hashes = got.column(0).to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], len(hashes) - order


def row_key() -> Column:
    """Tells rows of other ids or texts apart."""
    return F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), F.col("text").isNull(), F.col("text"))


def _few(df: DataFrame) -> DataFrame:
    """A written table as one side of a join: broadcast where its counted rows are few, else merged."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("merge")


NODES = "row long, doc_id long, node long, n long, fp long, sign array<long>, prefix array<long>"


def nodes(docs: DataFrame) -> DataFrame:
    """(row, doc_id, node, n, fp, sign, prefix) for every row of docs: the key of its set, the set's size, fingerprint, bits and first shingles."""
    known = docs.sparkSession.sparkContext.broadcast(common_shingles(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            keys, sizes, fps, signs, first = [], [], [], [], []
            for t in b.column(2).to_pylist():
                own = shingle_set(t)
                keys.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                sizes.append(len(own))
                fps.append(fingerprint(own))
                signs.append(bitmap(own))
                first.append(prefix(own, *known.value).view(np.int64))
            each = SIGN_BITS // 64
            bits = pa.ListArray.from_arrays(pa.array(np.arange(len(signs) + 1) * each, pa.int32()), pa.array(np.frombuffer(b"".join(signs), dtype=np.int64)))
            ends = np.cumsum([0, *map(len, first)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *first])))
            keys = pa.array(np.array(keys, dtype=np.uint64).view(np.int64))
            columns = [b.column(0), b.column(1), keys, pa.array(sizes, pa.int64()), pa.array(fps, pa.int64()), bits, lists]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "node", "n", "fp", "sign", "prefix"])

    rows = docs.select(row_key().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, NODES)


def near_bits(own: DataFrame) -> DataFrame:
    """Pairs (u, v) of nodes whose fingerprints differ in three bits at most, enough to span what they link: the Gray-order index's."""
    spark = own.sparkSession
    least = materialise(own.groupBy("fp").agg(F.min("node").alias("id")), "neardup-fps")
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), least.count() * len(TABLES) // 2_000_000)
    equal = own.select("fp", F.col("node").alias("u")).join(least.hint("merge"), "fp").where("u <> id").select("u", F.col("id").alias("v"))
    return forest(least, n_parts).unionByName(equal)


def near_bitmaps() -> str:
    """Whether sets of nu and nv shingles with the bits su and sv can be alike: a differing bit is a shingle that one of them lacks."""
    apart = " + ".join(f"bit_count(su[{k}] ^ sv[{k}])" for k in range(SIGN_BITS // 64))
    return f"{WHOLE + PART} * ({apart}) <= {WHOLE - PART} * (nu + nv)"


def plausible(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """Those of pairs (u, v) whose sizes and bits allow them to be alike."""

    def end(c: str) -> DataFrame:
        return own.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sign").alias(f"s{c}")).hint("merge")

    sized = pairs.join(end("u"), "u").join(end("v"), "v").where(f"{WHOLE} * least(nu, nv) >= {PART} * greatest(nu, nv)")
    return sized.where(near_bitmaps()).select("u", "v")


def verified(pairs: DataFrame, known: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of pairs (u, v), a written table, whose texts are alike. Only their own texts move."""
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    rows = materialise(known.groupBy("node").agg(F.min("row").alias("row")).join(ends, "node", "left_semi"), "neardup-ends")
    texts = docs.select(row_key().alias("row"), "text").join(_few(rows), "row").groupBy("node").agg(F.first("text").alias("text"))
    texts = materialise(texts, "neardup-texts")
    both = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")).hint("merge"), "u")
    both = both.join(texts.select(F.col("node").alias("v"), F.col("text").alias("b")).hint("merge"), "v").select("u", "v", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        size = 0
        for b in small_batches(batches, 64):
            keep = []
            for u, v, *texts in zip(*[c.to_pylist() for c in b.columns]):
                if size > HELD_SHINGLES:
                    held, size = {}, 0
                for node, text in zip((u, v), texts):
                    if node not in held:
                        held[node] = shingle_set(text)
                        size += len(held[node])
                keep.append(alike(held[u], held[v]))
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return materialise(both.mapInArrow(run, "u long, v long"), "neardup-links")


def may_be_alike() -> Column:
    """Whether sets of nu and nv shingles that share so many first ones can be alike: of the set whose first shingles end
    earlier in the order, all that the other has too are among those shared or not among its first ones."""
    rest = f"greatest(nu - nu div {WHOLE}, nv - nv div {WHOLE}) - 1"
    return F.expr(f"{WHOLE + PART} * (shared + {rest}) >= {PART} * (nu + nv)")


def _stars(groups: DataFrame) -> DataFrame:
    """Edges (u, v) of each node to its component: they stand for all edges so far, and need no round of their own."""
    return groups.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))


def _grouped(lists: DataFrame, groups: DataFrame, tag: str) -> DataFrame:
    """lists with each node's component so far."""
    groups = groups.withColumnRenamed("component", "c")
    return materialise(lists.join(groups.hint("merge"), "node", "left").withColumn("c", F.coalesce("c", "node")), tag)


def _open(grouped: DataFrame) -> DataFrame:
    """(h, top, groups): each list's largest component and its number of them."""
    return grouped.groupBy("h", "c").agg(F.count("*").alias("k")).groupBy("h").agg(F.max_by("c", "k").alias("top"), F.count("*").alias("groups"))


def links(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Edges (u, v) between nodes that are alike, enough of them to span every component."""
    own = materialise(known.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "fp", "sign")]), "neardup-nodes")
    # most first shingles are one text's only: counted by themselves, before their texts move
    each = known.select("node", "n", F.posexplode("prefix").alias("at", "h"))
    often = each.groupBy("h").count().where("count > 1").select("h")
    lists = materialise(each.join(often.hint("merge"), "h", "left_semi").distinct(), "neardup-lists")
    least = lists.groupBy("h").agg(F.count("*").alias("texts"), F.min(F.struct("node", "n")).alias("least")).where("texts > 1")
    least = least.select("h", F.col("least.node").alias("u"), F.col("least.n").alias("nu"))
    near = lists.join(least.hint("merge"), "h").where("node <> u").groupBy("u", F.col("node").alias("v")).agg(F.count("*").alias("shared"), F.first("nu").alias("nu"), F.first("n").alias("nv"))
    near = near.where(may_be_alike()).select("u", "v")
    indexed = near_bits(own).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    near = materialise(plausible(near.unionByName(indexed).distinct(), own), "neardup-pairs")
    groups = components(verified(near, known, docs))

    # many alike texts may not be alike to one least text: several of every crowded list meet all others of it
    for again in range(PIVOT_ROUNDS):
        grouped = _grouped(lists, groups, "neardup-grouped")
        crowded = grouped.join(_open(grouped).where(f"groups > {CROWD}").select("h").hint("merge"), "h")
        drawn = F.array(*[F.min(F.struct(F.xxhash64("node", F.lit(again * PIVOTS + k)).alias("draw"), F.col("node").alias("v"), F.col("c").alias("cv"))) for k in range(PIVOTS)])
        pivots = crowded.groupBy("h").agg(drawn.alias("pivots")).select("h", F.explode(F.array_distinct("pivots")).alias("p")).select("h", "p.v", "p.cv")
        met = crowded.select("h", "node", "c").hint("merge").join(pivots, "h").where("c <> cv").select(F.least("node", "v").alias("u"), F.greatest("node", "v").alias("v")).distinct()
        groups = components(_stars(groups).unionByName(verified(materialise(plausible(met, own), "neardup-pairs"), known, docs)))
    grouped = _grouped(lists, groups, "neardup-grouped")
    open_ = grouped.join(_open(grouped).where("groups > 1").select("h", "top").hint("merge"), "h")
    # with the bits of each text, so that the join itself lets only plausible pairs out
    open_ = materialise(open_.join(own.select("node", "sign").hint("merge"), "node"), "neardup-open")
    x = open_.select("h", F.col("node").alias("u"), F.col("n").alias("nu"), F.col("at").alias("iu"), F.col("c").alias("cu"), "top", F.col("sign").alias("su"))
    y = open_.select("h", F.col("node").alias("v"), F.col("n").alias("nv"), F.col("at").alias("iv"), F.col("c").alias("cv"), F.col("sign").alias("sv"))
    # the smaller set comes first; two sets of similarity 0.8 share least = 4/9 of their sizes' sum, so before the first
    # shingle that they share a set has its size less least others at most: a pair comes at such places of a list only
    least = f"ceil({PART} * (nu + nv) / {PART + WHOLE}d)"
    apart = x.hint("merge").join(y, "h").where("cu <> cv and (cu <> top or cv <> top) and (nu < nv or nu = nv and u < v)").where(f"iu + {least} <= nu and iv + {least} <= nv").where(near_bitmaps())
    apart = apart.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().join(near.hint("merge"), ["u", "v"], "left_anti")
    return _stars(groups).unionByName(verified(materialise(apart, "neardup-pairs"), known, docs))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row left of each component: that of the smallest doc_id. The rows that go are few beside the table, so that texts stay where they are while the goers' keys can be broadcast."""
    lighter_batches(docs.sparkSession)
    known = materialise(nodes(docs), "neardup")
    groups = known.select("node", "doc_id", "row").join(components(links(docs, known)).hint("merge"), "node", "left").select("doc_id", "row", F.coalesce("component", "node").alias("component"))
    groups = materialise(groups, "neardup-groups")
    stay = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least")).select(F.col("least.row").alias("row"))
    gone = materialise(groups.join(stay.hint("merge"), "row", "left_anti").select("row").distinct(), "neardup-gone")
    twice = materialise(groups.groupBy("row").count().where("count > 1").select("row").join(gone.hint("merge"), "row", "left_anti"), "neardup-twice")
    carried = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), row_key().alias("row"))
    kept = carried.join(_few(gone), "row", "left_anti")
    if twice.isEmpty():
        return kept.select("_doc.*")
    # rows of one id and one text: one of them stays
    once, more = kept.join(_few(twice), "row", "left_anti"), kept.join(_few(twice), "row", "left_semi")
    return once.unionByName(more.groupBy("row").agg(F.first("_doc").alias("_doc")).select(*once.columns)).select("_doc.*")
