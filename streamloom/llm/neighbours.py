"""Approximate nearest neighbours with score-aware anisotropic quantisation.

Unit vectors are cut into subspaces of two dimensions with sixteen centroids each, four bits a subspace, two codes a
byte. Codebooks and codes minimise h_perp |r|^2 + (h_par - h_perp) (r.x)^2, which penalises the residual r along the
vector more than across it, since only that part changes the scores that matter to maximum inner product. Codes are
chosen by coordinate descent over the subspaces, centroids by the weighted least squares that the loss gives.

The index keeps two figures of each residual: its part along the vector, which corrects the rough score, and the length of
the rest, which tells how far the score may be off: by that length times the query's part across the vector, and unless
both directions agree, by SPREAD / sqrt(dimension - 1) of it. A search scans the codes of every row with a query's tables
of partial products, one table of 256 entries a byte, and computes the exact cosine, in double precision on the original
vectors, of every row whose corrected score plus that deviation reaches the worst of the nearest so far. There is no
limit on their number: a large group of near copies is reranked as a whole, and batches do not matter. With a
spread of sqrt(dimension - 1) the bound is certain and the result exact. Equal vectors of a batch are scanned once.

Defined cases: vectors that are null, zero, of another dimension than most, or hold a null or non-finite component take
no part, and null ids neither; components of any finite size count; ties go to the smaller id; rows that share a query's
id are its own, an id that repeats with one score counts once, and asks with the
least of its vectors; fewer candidates than asked give all of them; an empty table gives an empty result; only vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

FIT_ROWS = 8192
QUERY_BLOCK = 2048
#: Standard deviations of a random direction that a rough score may be off; and how many rows of a task's first batch are ranked before the bound applies.
SPREAD, FIRST = 4.0, 100
THRESHOLD = 0.2
SUB, CODES = 2, 16


class Quantiser:
    """Codebooks (subspaces, CODES, SUB) of an even number of subspaces and the weight of the parallel residual."""

    def __init__(self, dim: int):
        self.dim = dim
        self.m = 2 * -(-dim // (2 * SUB))
        self.extra = max(1.0, (dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2)) - 1.0  # h_par - h_perp, h_perp being 1
        self.books = np.zeros((self.m, CODES, SUB))

    def parts(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors in subspaces, padded with zeros: (n, m, SUB)."""
        x = x / np.sqrt((x * x).sum(1, keepdims=True))
        return np.pad(x, ((0, 0), (0, self.m * SUB - self.dim))).reshape(len(x), self.m, SUB)

    def fit(self, x: np.ndarray, rounds: int = 6, seed: int = 7) -> Quantiser:
        p = self.parts(x)
        rng = np.random.default_rng(seed)
        for m in range(self.m):
            book = p[rng.choice(len(p), CODES, replace=len(p) < CODES), m] + 1e-9 * rng.standard_normal((CODES, SUB))
            for _ in range(8):
                code = ((p[:, m, None] - book) ** 2).sum(2).argmin(1)
                n = np.bincount(code, minlength=CODES)
                sums = np.stack([np.bincount(code, p[:, m, d], minlength=CODES) for d in range(SUB)], 1)
                book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], book)
            self.books[m] = book
        for _ in range(rounds):
            code = self.assign(p)
            along = self._along(p, code)
            for m in range(self.m):
                own = p[:, m]
                rest = along - ((own - self.books[m, code[:, m]]) * own).sum(1)
                for c in np.unique(code[:, m]):
                    at = code[:, m] == c
                    v = own[at]
                    left = len(v) * np.eye(SUB) + self.extra * v.T @ v
                    right = v.sum(0) + self.extra * ((rest[at] + (v * v).sum(1))[:, None] * v).sum(0)
                    self.books[m, c] = np.linalg.solve(left, right)
                along = rest + ((own - self.books[m, code[:, m]]) * own).sum(1)
        return self

    def _along(self, p: np.ndarray, code: np.ndarray) -> np.ndarray:
        """r.x of each vector."""
        return sum(((p[:, m] - self.books[m, code[:, m]]) * p[:, m]).sum(1) for m in range(self.m))

    def assign(self, p: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (n, m) by coordinate descent on the anisotropic loss."""
        code = np.stack([((p[:, m, None] - self.books[m]) ** 2).sum(2).argmin(1) for m in range(self.m)], 1)
        along = self._along(p, code)
        each = np.arange(len(p))
        for _ in range(sweeps):
            for m in range(self.m):
                r = p[:, m, None] - self.books[m]
                dots = (r * p[:, m, None]).sum(2)
                rest = along - dots[each, code[:, m]]
                code[:, m] = ((r * r).sum(2) + self.extra * (rest[:, None] + dots) ** 2).argmin(1)
                along = rest + dots[each, code[:, m]]
        return code

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed codes, two a byte: (n, m / 2); the residuals' parts along the vectors and the lengths of the rest."""
        p = self.parts(x)
        code = self.assign(p)
        along = self._along(p, code)
        squares = sum(((p[:, m] - self.books[m, code[:, m]]) ** 2).sum(1) for m in range(self.m))
        code = code.astype(np.uint8)
        return code[:, ::2] << 4 | code[:, 1::2], along, np.sqrt(np.maximum(squares - along * along, 0.0))

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Partial products by byte value: (queries, m / 2, 256)."""
        t = np.einsum("qms,mcs->qmc", self.parts(q), self.books)
        return (t[:, ::2, :, None] + t[:, 1::2, None, :]).reshape(len(q), self.m // 2, CODES * CODES).astype(np.float32)


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """Rows that take part, embeddings as doubles, and their dimension: the most frequent one, of equals the smallest."""
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(
        F.col("vec_id").isNotNull()
        & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists("embedding", lambda v: v != 0)
    )
    top = whole.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = top["dim"] if top else 0
    return whole.where(F.size("embedding") == dim), dim


def _scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, which changes no digit of a cosine, so that squares neither vanish nor overflow."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None]) if len(x) else x


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return _scaled(column.flatten().to_numpy().reshape(-1, dim))


def index(vectors: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[DataFrame, Quantiser]:
    """(vec_id, embedding, code, along, across) of every usable row, written to the shared folder; the codebooks are fitted on about fit_rows rows drawn by a hash of the id."""
    rows, dim = usable(vectors)
    share = min(1.0, fit_rows / max(rows.count(), 1))
    drawn = rows.where(F.pmod(F.xxhash64("vec_id", F.lit("fit")), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy("vec_id").select("embedding").toPandas()["embedding"]
    quantiser = Quantiser(max(dim, 1))
    if len(drawn):
        quantiser.fit(_scaled(np.stack(drawn)))
    sent = rows.sparkSession.sparkContext.broadcast(quantiser)

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in got:
            if b.num_rows:
                code, along, across = sent.value.encode(_matrix(b.column(1), dim))
                columns = [*b.columns, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(along), pa.array(across)]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "embedding", "code", "along", "across"])

    return materialise(rows.mapInArrow(run, "vec_id long, embedding array<double>, code binary, along double, across double"), "vector-codes"), quantiser


_NONE = np.iinfo(np.int64).max


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row by score, then id, equal pairs once; padding has score -inf and id _NONE."""
    order = np.lexsort((ids, -scores), axis=1)
    scores, ids = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)
    again = np.zeros(ids.shape, dtype=bool)
    again[:, 1:] = (ids[:, 1:] == ids[:, :-1]) & (scores[:, 1:] == scores[:, :-1])
    order = np.argsort(again, axis=1, kind="stable")[:, :k]
    again = np.take_along_axis(again, order, 1)
    return np.where(again, -np.inf, np.take_along_axis(scores, order, 1)), np.where(again, _NONE, np.take_along_axis(ids, order, 1))


class Batch:
    """The distinct vectors of a batch of rows, each with its k + 1 smallest ids: one may be a query's own."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, along: np.ndarray, across: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], np.ascontiguousarray(x[order])
        _, first, group = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
        pairs = np.unique(np.stack([group, ids], 1), axis=0)
        place = np.arange(len(pairs)) - np.searchsorted(pairs[:, 0], pairs[:, 0])
        few = place <= k
        self.members = np.full((len(first), k + 1), _NONE)
        self.members[pairs[few, 0], place[few]] = pairs[few, 1]
        self.x, self.norms = x[first], np.sqrt((x[first] ** 2).sum(1))
        self.codes, self.along, self.across = codes[order][first], along[order][first], across[order][first]

    def rough(self, tables: np.ndarray) -> np.ndarray:
        """Scores from the codes: (queries, vectors)."""
        out = np.zeros((len(tables), len(self.x)), dtype=np.float32)
        for b in range(self.codes.shape[1]):
            out += np.take(tables[:, b], self.codes[:, b], axis=1)
        return out

    def exact(self, row: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Cosines of vectors and queries in pairs, some thousands at a time."""
        out = np.empty(len(row))
        for at in range(0, len(row), 16384):
            r = row[at : at + 16384]
            v = q[at : at + 16384] if q.ndim == 2 else q
            out[at : at + 16384] = (self.x[r] * v).sum(1) / (self.norms[r] * np.sqrt((v * v).sum(-1)))
        return out

    def nearest(self, row: np.ndarray, scores: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (score, id) among the given vectors' members other than the query's own id."""
        first = np.where(self.members[row, 0] == own, self.members[row, 1], self.members[row, 0])
        order = np.lexsort((first, np.where(first == _NONE, np.inf, -scores)))[:k]
        ids = self.members[row[order]]
        got = np.where((ids == own) | (ids == _NONE), -np.inf, scores[order][:, None])
        return got.ravel(), np.where(np.isinf(got), _NONE, ids).ravel()


def scan(batch: Batch, query_ids: np.ndarray, q: np.ndarray, tables: np.ndarray, scores: np.ndarray, ids: np.ndarray, spread: float) -> None:
    """Take the vectors of a batch into the nearest so far of each query, scores and ids (queries, k), in place."""
    k = scores.shape[1]
    certain = np.maximum(1.0 - batch.along, 1e-9)
    width = batch.across * min(1.0, spread / max(np.sqrt(q.shape[1] - 1), 1e-9))
    for at in range(0, len(q), 256):
        rough = batch.rough(tables[at : at + 256])
        for j in range(len(rough)):
            i = at + j

            def take(row: np.ndarray, i: int = i) -> None:
                s, who = batch.nearest(row, batch.exact(row, q[i]), query_ids[i], k)
                s, who = best(np.concatenate([scores[i], s])[None], np.concatenate([ids[i], who])[None], k)
                scores[i], ids[i] = s[0], who[0]

            if np.isinf(scores[i, -1]):  # rank some, so that there is a worst of the nearest
                n = min(FIRST, len(batch.x))
                take(np.argpartition(-rough[j], n - 1)[:n] if n < len(batch.x) else np.arange(n))
            worst = scores[i, -1]
            # an exact score s obeys s (1 - along) = rough + the query times the rest of the residual
            reach = (rough[j] + width * np.sqrt(max(0.0, 1.0 - max(worst, 0.0) ** 2))) / certain
            row = np.flatnonzero((reach + 1e-4 >= worst) | (batch.along >= 1.0)) if not np.isinf(worst) else np.arange(len(batch.x))
            if len(row):
                take(row)


def search(codes: DataFrame, quantiser: Quantiser, queries: DataFrame, k: int = 5, spread: float = SPREAD) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row of queries (vec_id, embedding) in an index. A larger spread finds more; sqrt(dimension - 1) is exact.

    Queries are scanned against all rows in blocks of about QUERY_BLOCK, so what is broadcast stays bounded; a task hands
    on k rows a query.
    """
    spark, dim = codes.sparkSession, quantiser.dim
    n_blocks = queries.count() // QUERY_BLOCK + 1
    out = None
    for block in range(n_blocks):
        own = queries.where(F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(n_blocks)) == block).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).orderBy("vec_id").toPandas()
        if not len(own):
            continue
        q = _scaled(np.stack(own["embedding"]))
        sent = spark.sparkContext.broadcast((own["vec_id"].to_numpy(), q, quantiser.tables(q)))

        def run(got: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            query_ids, q, tables = sent.value
            scores, ids = np.full((len(q), k), -np.inf), np.full((len(q), k), _NONE)
            for b in got:
                if b.num_rows:
                    packed = np.frombuffer(b"".join(b.column(2).to_pylist()), dtype=np.uint8).reshape(b.num_rows, -1)
                    batch = Batch(b.column(0).to_numpy(), _matrix(b.column(1), dim), packed, b.column(3).to_numpy(), b.column(4).to_numpy(), k)
                    scan(batch, query_ids, q, tables, scores, ids, spread)
            row, col = np.nonzero(ids != _NONE)
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[row]), pa.array(ids[row, col]), pa.array(scores[row, col])], ["query_id", "vec_id", "score"])

        found = codes.mapInArrow(run, "query_id long, vec_id long, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.distinct().withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def self_search(vectors: DataFrame, every: int = 50, k: int = 5, **options) -> DataFrame:
    """Neighbours of the rows whose vec_id is divisible by every, among all rows but their own."""
    codes, quantiser = index(vectors)
    return search(codes, quantiser, codes.where(F.col("vec_id") % every == 0), k, **options)
