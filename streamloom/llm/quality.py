"""Quality classifier: interpolated modified Kneser-Ney n-grams trained on trusted text.

The model is of characters as they are (16-bit units of UTF-16, so that ORDER of them are one 64-bit number and nothing is
folded or hashed): what it gathers grows with the corpus. One model a language is trained on the documents that the
labels trust, less a held-out fold that only the quantiles are taken from.

Training reduces texts to distinct n-grams with counts before the shuffle. From then on everything is joins of count
tables sharded by (language, n-gram): continuation counts of the lower orders from the order above, discounts from
counts of counts, sums by context, and from order one up the interpolated probability of every n-gram that is asked for,
backing off where the trusted text lacks it.

Scoring is a join by blocks. Documents go, compressed, to blocks of one language and about BLOCK_BYTES of text. A block
asks for each of its distinct n-grams once; the asked n-grams meet the sharded table; the answers return to their block,
where each document's log-probabilities are summed to a perplexity. No table is collected or broadcast, and a block needs
only the probabilities of its own n-grams. A document is kept if its perplexity lies between two quantiles of the
held-out trusted documents' perplexities in its language, widened by a margin.

Defined cases: null and blank texts have no perplexity and are not kept; a language without trusted documents has no
model, its other documents have no perplexity and are kept; a language of fewer than LEAST_TRUSTED trusted documents
trains on all of them and takes its quantiles from the same; a null language is a language of its own; a document of
several labels is trusted if all trust it; texts of any length are scored whole; repeated rows are scored alike; an empty
table gives an empty result; only doc_id, text and lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lighter_batches, materialise

ORDER, BITS = 4, 16
PIECE = 1 << 20
BLOCK_BYTES = 24 << 20
HELD_BYTES = 16 << 20
LOW, HIGH, MARGIN = 0.001, 0.995, 1.05
LEAST_TRUSTED = 100
ON = ["lang", "gram"]
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_SLOT_BITS = 21


def grams(text: str, order: int = ORDER) -> Iterator[np.ndarray]:
    """The n-grams of a text as numbers, one for each 16-bit unit, the text preceded by blanks; in pieces."""
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype="<u2")
    held = np.full(order - 1, 32, dtype=np.uint64)
    for at in range(0, len(units), PIECE):
        own = np.concatenate([held, units[at : at + PIECE].astype(np.uint64)])
        held = own[len(own) - order + 1 :]
        out = own[: len(own) - order + 1].copy()
        for k in range(1, order):
            out = out << np.uint64(BITS) | own[k : k + len(out)]
        yield out


def slots(g: np.ndarray) -> np.ndarray:
    return (g * _SPREAD) >> np.uint64(64 - _SLOT_BITS)


class Seen:
    """Lets an n-gram of a group (language, block) through the first time, and again only where another took its slot."""

    def __init__(self):
        # an entry that belongs to another slot than its own stands for an empty one
        self.table = np.zeros(1 << _SLOT_BITS, dtype=np.uint64)
        self.table[0] = 1
        self.owner = np.full(1 << _SLOT_BITS, -1, dtype=np.int32)
        self.groups: dict = {}

    def new(self, group, g: np.ndarray) -> np.ndarray:
        number = self.groups.setdefault(group, len(self.groups))
        at = (slots(g) + np.uint64(number) * np.uint64(7919)) & np.uint64((1 << _SLOT_BITS) - 1)
        fresh = (self.table[at] != g) | (self.owner[at] != number)
        g, at = g[fresh], at[fresh]
        self.table[at], self.owner[at] = g, number
        return np.unique(g)


def trusted(labels: DataFrame) -> DataFrame:
    """Ids that every label of theirs calls good and not toxic."""
    good = F.min(((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int"))
    return labels.where("doc_id is not null").groupBy("doc_id").agg(good.alias("good")).where("good = 1").select(F.col("doc_id").cast("long").alias("trusted_id"))


def held_out(doc_id: Column) -> Column:
    """A quarter of the trusted documents, by their ids."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 1


def count_grams(texts: DataFrame) -> DataFrame:
    """(lang, gram, n) of trusted (lang, text)."""

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang in sorted(held):
                every, n = np.unique(np.concatenate(held[lang]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(every)), pa.array(every.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])
            held.clear()

        for b in got:
            for lang, text in zip(*(b.column(c).to_pylist() for c in range(2))):
                for g in grams(text or ""):
                    held.setdefault(lang, []).append(g)
                    size += len(g)
                if size > 4 << 20:
                    yield from flush()
                    size = 0
        yield from flush()

    return texts.mapInArrow(run, "lang string, gram long, n long").groupBy(ON).agg(F.sum("n").alias("n"))


def asked_grams(texts: DataFrame) -> DataFrame:
    """(lang, gram): the distinct n-grams of (lang, text)."""

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for b in got:
            for lang, text in zip(*(b.column(c).to_pylist() for c in range(2))):
                for g in grams(text or ""):
                    if len(new := seen.new(lang, g)):
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(new)), pa.array(new.view(np.int64))], ON)

    return texts.mapInArrow(run, "lang string, gram long").distinct()


def _discounts(counts: DataFrame) -> dict[str, tuple[float, float, float]]:
    """Modified Kneser-Ney discounts of one order by language, from its counts of counts: four numbers a language reach the driver."""
    out = {}
    for r in counts.groupBy("lang").agg(*[F.sum((F.col("n") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]).collect():
        n = [r[f"n{k}"] for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        out[r["lang"]] = tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.1), k - 0.05) if n[k - 1] else 0.5 for k in (1, 2, 3))
    return out


def probabilities(counts: DataFrame, asked: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, p) of the asked n-grams of the languages in counts: the interpolated probability of the last unit, given those before it."""
    spark = counts.sparkSession
    levels, wanted = [counts], [asked]
    for k in range(order - 1, 0, -1):
        tail = F.col("gram").bitwiseAND(F.lit((1 << BITS * k) - 1)).alias("gram")
        # a lower order counts how many different units come before it
        levels.append(materialise(levels[-1].select("lang", tail).groupBy(ON).agg(F.count("*").alias("n")), f"counts-{k}"))
        wanted.append(materialise(wanted[-1].select("lang", tail).distinct(), f"asked-{k}"))
    below = None
    for k in range(1, order + 1):
        own = levels[order - k]
        table = spark.createDataFrame([(lang, *d) for lang, d in sorted(_discounts(own).items())], "lang string, d1 double, d2 double, d3 double")
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        context = F.shiftrightunsigned("gram", BITS).alias("context") if k > 1 else F.lit(0).cast("long").alias("context")
        lessened = own.join(F.broadcast(table), "lang").select(*ON, context, "n", d.alias("d"))  # a row a language
        sums = lessened.groupBy("lang", "context").agg(F.sum("n").alias("all"), F.sum(F.col("d").cast("decimal(28,10)")).cast("double").alias("freed"))
        p = wanted[order - k].select(*ON, context).join(lessened.select(*ON, "n", "d"), ON, "left").join(sums, ["lang", "context"], "left")
        if below is None:
            lower = F.lit(1.0 / (1 << BITS))
        else:
            p = p.withColumn("tail", F.col("gram").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1))).join(below.select("lang", F.col("gram").alias("tail"), F.col("p").alias("lower")), ["lang", "tail"])
            lower = F.col("lower")
        share = F.coalesce((F.col("n") - F.col("d")) / F.col("all"), F.lit(0.0)) + F.coalesce(F.col("freed") / F.col("all"), F.lit(1.0)) * lower
        below = materialise(p.select(*ON, share.alias("p")), f"grams-{k}")
    return below


def _unpack(blob: bytes, n: int) -> list[str | None]:
    data = zstandard.decompress(blob)
    lengths = np.frombuffer(data, dtype="<i4", count=n)
    out, at = [], 4 * n
    for k in lengths.tolist():
        out.append(None if k < 0 else data[at : at + k].decode("utf-8", "surrogatepass"))
        at += max(k, 0)
    return out


def packed(docs: DataFrame) -> DataFrame:
    """(block, lang, ids, texts): docs (block, lang, doc_id, text) in compressed lots of one block each."""

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, str], tuple[list, list]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (block, lang), (ids, texts) in sorted(held.items()):
                raw = [None if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
                lengths = np.array([-1 if t is None else len(t) for t in raw], dtype="<i4")
                blob = zstandard.compress(lengths.tobytes() + b"".join(t for t in raw if t), 3)
                columns = [pa.array([block], pa.int64()), pa.array([lang]), pa.array([ids], pa.list_(pa.int64())), pa.array([blob], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["block", "lang", "ids", "texts"])
            held.clear()

        for b in got:
            for block, lang, doc_id, text in zip(*(b.column(c).to_pylist() for c in range(4))):
                ids, texts = held.setdefault((block, lang), ([], []))
                ids.append(doc_id)
                texts.append(text)
                size += len(text or "")
                if size > HELD_BYTES:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.select("block", "lang", "doc_id", "text").mapInArrow(run, "block long, lang string, ids array<long>, texts binary")


def _asked_by_block(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = Seen()
    for b in got:
        for row in b.to_pylist():
            new = [seen.new(row["block"], g) for t in _unpack(row["texts"], len(row["ids"])) for g in grams(t or "")]
            new = np.unique(np.concatenate([np.zeros(0, np.uint64), *new]))
            yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(new), pa.int64()), pa.array([row["lang"]] * len(new), pa.string()), pa.array(new.view(np.int64))], ["block", *ON])


class Answers:
    """Log-probabilities by n-gram, found by slot, the few that share a slot by search."""

    def __init__(self, g: np.ndarray, logs: np.ndarray):
        g, first = np.unique(g, return_index=True)
        self.grams, self.logs = g, logs[first]
        self.place = np.zeros(1 << _SLOT_BITS, dtype=np.int32)
        self.place[slots(g)] = np.arange(len(g))

    def total(self, g: np.ndarray) -> float:
        at = self.place[slots(g)]
        off = np.flatnonzero(self.grams[at] != g)
        if len(off):
            at[off] = np.minimum(np.searchsorted(self.grams, g[off]), len(self.grams) - 1)
            if (self.grams[at[off]] != g[off]).any():
                raise ValueError("an n-gram of the block has no answer")
        return float(self.logs[at].sum())


SCORED = "doc_id long, lang string, perplexity double"


def _score_block(texts: pa.Table, answers: pa.Table) -> pa.Table:
    ids, langs, out = [], [], []
    if texts.num_rows:
        known = Answers(answers.column("gram").to_numpy().view(np.uint64), answers.column("log").to_numpy()) if answers.num_rows else None
        for row in texts.to_batches(max_chunksize=1):
            row = row.to_pylist()[0]
            for doc_id, text in zip(row["ids"], _unpack(row["texts"], len(row["ids"]))):
                ids.append(doc_id)
                langs.append(row["lang"])
                if not (text or "").strip():
                    out.append(None)
                    continue
                n, total = 0, 0.0
                for g in grams(text):
                    total, n = total + known.total(g), n + len(g)
                out.append(float(np.exp(-total / n)))
    return pa.table([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(out, pa.float64())], ["doc_id", "lang", "perplexity"])


def score(docs: DataFrame, table: DataFrame, sizes: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, lang, perplexity) of the rows of docs in the languages of sizes (lang, bytes), by blocks. The texts' one exchange serves both the asking and the scoring."""
    first, rows = 0, []
    for r in sizes.orderBy("lang").collect():  # a row a language
        n = int((r["bytes"] or 0) // block_bytes) + 1
        rows.append((r["lang"], first, n))
        first += n
    spark = docs.sparkSession
    blocks = spark.createDataFrame(rows, "lang string, first long, n long")
    spread = docs.join(F.broadcast(blocks), "lang").withColumn("block", F.col("first") + F.pmod(F.xxhash64("doc_id", "text"), F.col("n")))
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), first)
    texts = packed(spread).repartition(n_parts, "block")
    asked = texts.mapInArrow(_asked_by_block, "block long, lang string, gram long")
    answers = asked.join(table.select(*ON, F.log("p").alias("log")), ON).select("block", "gram", "log")
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score_block, SCORED)


def classify(docs: DataFrame, labels: DataFrame, low: float = LOW, high: float = HIGH, margin: float = MARGIN) -> DataFrame:
    """(doc_id, lang, perplexity, low, high, keep) of every row of docs."""
    lighter_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("?")).alias("lang"), "text")
    ids = materialise(trusted(labels), "trusted")
    marked = docs.join(ids, docs["doc_id"] == ids["trusted_id"], "left")
    about = marked.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("trusted_id").alias("trusted"))
    about = materialise(about.where("trusted > 0").withColumn("few", F.col("trusted") < LEAST_TRUSTED), "languages")  # a row a modelled language
    own = docs.join(F.broadcast(about.select("lang", "few")), "lang")
    taught = own.join(ids, own["doc_id"] == ids["trusted_id"], "left_semi").where(F.col("few") | ~held_out(F.col("doc_id")))
    counts = materialise(count_grams(taught.select("lang", "text")), "gram-counts")
    modelled = counts.select("lang").distinct()
    known = docs.join(F.broadcast(modelled), "lang", "left_semi")
    table = probabilities(counts, materialise(asked_grams(known.select("lang", "text")), "asked"))
    scored = materialise(score(known, table, about.join(modelled, "lang", "left_semi").select("lang", "bytes")), "perplexities")

    sample = scored.where("perplexity is not null").join(ids, scored["doc_id"] == ids["trusted_id"], "left_semi").join(F.broadcast(about.select("lang", "few")), "lang")
    ends = lambda x: F.percentile_approx(x, [low, high], 10_000)
    aside = F.when(F.col("few") | held_out(F.col("doc_id")), F.col("perplexity"))
    limits = sample.groupBy("lang").agg(F.coalesce(ends(aside), ends(F.col("perplexity"))).alias("q"))
    limits = limits.select("lang", (F.col("q")[0] / margin).alias("low"), (F.col("q")[1] * margin).alias("high"))
    judged = scored.join(F.broadcast(limits), "lang", "left").withColumn("keep", F.coalesce(F.col("perplexity").between(F.col("low"), F.col("high")), F.lit(False)))
    none = F.lit(None).cast("double")
    others = docs.join(F.broadcast(modelled), "lang", "left_anti").select("doc_id", "lang", none.alias("perplexity"), none.alias("low"), none.alias("high"), F.coalesce(F.col("text").rlike(r"(?U)\S"), F.lit(False)).alias("keep"))
    every = judged.select(*others.columns).unionByName(others)
    return every.withColumn("lang", F.when(F.col("lang") != "?", F.substr("lang", F.lit(2))))
