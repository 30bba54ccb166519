"""Language identification with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's likelihood is the sum over all its
segmentations into pieces, by the forward algorithm; a text's is the product over its words. Words are lower-cased runs
of letters and combining marks of any length (one of over 262,143 letters is cut there); spans reach as far as the vocabulary's longest piece. The piece
probabilities are fitted by expectation maximisation: forward-backward gives each piece's expected count over the word
counts of a bounded sample of labelled documents, so many a language (all rows of a rare one), languages x vocabulary
numbers an iteration, whatever the size of the table.

Words of up to SHORT letters are summed together by length; longer ones each by itself, rescaled at every letter. A task
keeps the likelihoods of words that it has met.

Defined cases: a null text or one without a letter is 'und' with score 0; with nothing to learn from, every text is; a
letter that no piece covers costs the same in every language; ties go to the first language by code point; repeated rows
are predicted alike; an empty table gives an empty result; only doc_id, text and lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import lighter_batches, materialise, small_batches, without
from .textarrays import BASE, Chars, batches, mixed, span_hash

#: Labelled documents a language to fit on, about.
FIT_ROWS = 5_000
ITERATIONS = 3
SHORT = 32
#: Letters of a long word whose spans are weighed at a time.
STRETCH = 1 << 14
#: Weights of a stretch: of many languages a stretch is shorter.
STRETCH_WEIGHTS = 1 << 21
#: Likelihoods that a task keeps, at most.
KEPT_BYTES = 16 << 20
FLOOR = 1e-7
SMOOTHING = 0.1
UNKNOWN = "und"
_MARK = "▁"
_SLOTS = 1 << 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_pieces(path: str) -> list[str]:
    """The vocabulary's pieces that consist of letters, with their word mark if any."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return sorted({p.lower() for p in every if p == _MARK or p.removeprefix(_MARK).isalpha()})


class Pieces:
    """Piece numbers by span hash, in an open table."""

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        self.longest = max((len(p.removeprefix(_MARK)) for p in pieces), default=1) or 1
        self.keys = np.zeros(_SLOTS, dtype=np.uint64)
        self.values = np.full(_SLOTS, self.n, dtype=np.int32)  # n: no piece
        self.mark = self.n
        for i, p in enumerate(pieces):
            if p == _MARK:
                self.mark = i
            h = span_hash(p)
            at = self._slot(np.array([h], dtype=np.uint64))[0]
            while self.values[at] != self.n:
                at = (at + 1) % _SLOTS
            self.keys[at], self.values[at] = h, i

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (mixed(h) & np.uint64(_SLOTS - 1)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        at = self._slot(h)
        out = self.values[at].copy()
        open_ = np.flatnonzero((self.keys[at] != h) & (out != self.n))
        while len(open_):
            at[open_] = (at[open_] + 1) % _SLOTS
            out[open_] = self.values[at[open_]]
            open_ = open_[(self.keys[at[open_]] != h[open_]) & (out[open_] != self.n)]
        return out


def word_spans(chars: Chars) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words. Runs must hold a letter by themselves: marks alone count as letters."""
    return chars.words("LM")


def segment_ids(chars: Chars, starts: np.ndarray, length: int, pieces: Pieces) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray | None]]:
    """For words of one length: the piece of each inner span (i, j), and for i = 0 also the piece with the word mark."""
    out = {}
    mark = np.uint64(span_hash(_MARK))
    for j in range(1, length + 1):
        for i in range(max(0, j - pieces.longest), j):
            h = chars.hashes(starts + i, starts + j)
            out[i, j] = (pieces.find(h), pieces.find(mark + BASE * h) if i == 0 else None)
    return out


def span_weights(ids: dict, prob: np.ndarray, mark: int) -> dict[tuple[int, int], np.ndarray]:
    """Weight of each span for each word and language: its piece, at a word's start with the mark on or before it, or the floor of a single letter."""
    out = {}
    for (i, j), (plain, marked) in ids.items():
        w = prob[plain]
        if i == 0:
            w = prob[marked] + prob[mark] * w
        out[i, j] = w + FLOOR if j == i + 1 else w
    return out


def forward(weights: dict, length: int, n: int, langs: int, longest: int) -> list[np.ndarray]:
    """Sum over the segmentations of each prefix: arrays (words, languages) by prefix length."""
    alpha = [np.ones((n, langs))]
    for j in range(1, length + 1):
        alpha.append(sum(alpha[i] * weights[i, j] for i in range(max(0, j - longest), j)))
    return alpha


def by_length(lengths: np.ndarray, longest: int, spans_at_once: int = 300_000) -> Iterator[tuple[int, np.ndarray]]:
    """Words of one length of at most SHORT at a time, as many as have spans_at_once spans together."""
    for n in np.unique(lengths[lengths <= SHORT]):
        at = np.flatnonzero(lengths == n)
        at_once = spans_at_once // (int(n) * min(int(n), longest)) + 1
        for k in range(0, len(at), at_once):
            yield int(n), at[k : k + at_once]


class LongWord:
    """The spans of one word from start to end, weighed a stretch at a time."""

    def __init__(self, chars: Chars, start: int, end: int, pieces: Pieces, prob: np.ndarray):
        self.chars, self.start, self.n, self.pieces, self.prob = chars, start, end - start, pieces, prob
        self.stretch = max(1, min(STRETCH, STRETCH_WEIGHTS // (pieces.longest * prob.shape[1])))

    def spans(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Piece of each span by its end, low < end <= high, and its length less one; of those from the word's start also the piece with the mark."""
        ends = np.arange(low + 1, high + 1)
        ids = np.full((len(ends), self.pieces.longest), self.pieces.n)
        marked = ids.copy()
        for k in range(1, self.pieces.longest + 1):
            at = np.flatnonzero(ends >= k)
            if len(at):
                h = self.chars.hashes(self.start + ends[at] - k, self.start + ends[at])
                ids[at, k - 1] = self.pieces.find(h)
                if ends[at[0]] == k:
                    marked[at[0], k - 1] = self.pieces.find(np.uint64(span_hash(_MARK)) + BASE * h[:1])[0]
        return ids, marked

    def weights(self, low: int, high: int) -> np.ndarray:
        """(ends, length less one, languages)."""
        ids, marked = self.spans(low, high)
        w = self.prob[ids]
        for t in range(min(high, self.pieces.longest) - low):
            w[t, low + t] = self.prob[marked[t, low + t]] + self.prob[self.pieces.mark] * w[t, low + t]
        w[:, 0] += FLOOR
        return w

    def forward(self) -> Iterator[np.ndarray]:
        """For each letter the log of how the sum over segmentations up to it compares with that up to the letter before."""
        last = np.zeros((self.pieces.longest, self.prob.shape[1]))
        last[0] = 1.0  # sums of the prefixes before, nearest first, all divided by the nearest
        for low in range(0, self.n, self.stretch):
            for w in self.weights(low, min(self.n, low + self.stretch)):
                step = (last * w).sum(0)
                last[1:] = last[:-1] / step
                last[0] = 1.0
                yield np.log(step)

    def backward(self) -> np.ndarray:
        """log of the sum over segmentations from each place on, one language."""
        longest = self.pieces.longest
        out = np.full(self.n + 1, -np.inf)
        out[self.n] = 0.0
        for high in range(self.n, 0, -self.stretch):
            low = max(0, high - self.stretch)
            # spans from low on may end beyond high
            w = self.weights(low, min(self.n, high + longest))[:, :, 0]
            for i in range(high - 1, low - 1, -1):
                k = np.arange(1, min(longest, self.n - i) + 1)
                top = out[i + 1]
                out[i] = top + np.log((w[i + k - 1 - low, k - 1] * np.exp(out[i + k] - top)).sum())
        return out

    def expect(self, count: float, out: np.ndarray) -> None:
        """Add the expected uses of each piece to out, one language."""
        before = np.concatenate([[0.0], np.cumsum([x[0] for x in self.forward()])])
        after, prob, mark = self.backward(), self.prob[:, 0], self.pieces.mark
        for low in range(0, self.n, self.stretch):
            high = min(self.n, low + self.stretch)
            ids, marked = self.spans(low, high)
            ends = np.arange(low + 1, high + 1)[:, None]
            begin = ends - np.arange(1, self.pieces.longest + 1)[None]
            outer = count * np.where(begin >= 0, np.exp(before[np.maximum(begin, 0)] + after[ends] - before[-1]), 0.0)
            split = outer * prob[ids]
            first = begin == 0
            np.add.at(out, marked[first], outer[first] * prob[marked[first]])
            split[first] *= prob[mark]
            out[mark] += split[first].sum()
            np.add.at(out, ids, split)


def word_likelihoods(chars: Chars, starts: np.ndarray, ends: np.ndarray, pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    """Log-likelihood of each word in each language."""
    out = np.empty((len(starts), prob.shape[1]))
    for n, at in by_length(ends - starts, pieces.longest):
        weights = span_weights(segment_ids(chars, starts[at], n, pieces), prob, pieces.mark)
        out[at] = np.log(forward(weights, n, len(at), prob.shape[1], pieces.longest)[n])
    for i in np.flatnonzero(ends - starts > SHORT):
        out[i] = sum(LongWord(chars, int(starts[i]), int(ends[i]), pieces, prob).forward())
    return out


def expected_counts(chars: Chars, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray, pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece over all segmentations of the words, one language."""
    out = np.zeros(pieces.n + 1)
    for n, at in by_length(ends - starts, pieces.longest):
        ids = segment_ids(chars, starts[at], n, pieces)
        weights = span_weights(ids, prob, pieces.mark)
        alpha = forward(weights, n, len(at), 1, pieces.longest)
        beta = [np.zeros((len(at), 1)) for _ in range(n)] + [np.ones((len(at), 1))]
        for i in range(n - 1, -1, -1):
            for j in range(i + 1, min(n, i + pieces.longest) + 1):
                beta[i] += weights[i, j] * beta[j]
        for (i, j), (plain, marked) in ids.items():
            outer = (alpha[i] * beta[j] / alpha[n])[:, 0] * counts[at]
            if i == 0:
                out += np.bincount(marked, outer * prob[marked, 0], minlength=len(out))
                split = outer * prob[pieces.mark, 0] * prob[plain, 0]
                out[pieces.mark] += split.sum()
            else:
                split = outer * prob[plain, 0]
            out += np.bincount(plain, split, minlength=len(out))
    for i in np.flatnonzero(ends - starts > SHORT):
        LongWord(chars, int(starts[i]), int(ends[i]), pieces, prob).expect(float(counts[i]), out)
    return out[:-1]


class Kept:
    """Likelihoods of words met before, by hash, in slots; a newer word takes an older one's place."""

    def __init__(self, langs: int):
        self.bits = max(4, int(np.log2(KEPT_BYTES / (8 * langs + 8))))
        self.keys = np.zeros(1 << self.bits, dtype=np.uint64)
        self.values = np.zeros((1 << self.bits, langs))
        self.full = np.zeros(1 << self.bits, dtype=bool)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (mixed(h) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self._slot(h)
        return self.values[at], self.full[at] & (self.keys[at] == h)

    def put(self, h: np.ndarray, values: np.ndarray) -> None:
        # of several words of one slot one stays, whole
        at, one = np.unique(self._slot(h), return_index=True)
        self.keys[at], self.values[at], self.full[at] = h[one], values[one], True


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.Table]:
    """Batches of short rows put together again, so that vector operations have enough to work on."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


class Model:
    """Languages in order, pieces and their probabilities (pieces + 1, languages); the last row, of no piece, is zero."""

    def __init__(self, langs: list[str], pieces: Pieces, prob: np.ndarray):
        self.langs, self.pieces, self.prob = langs, pieces, prob


def _word_counts(labelled: DataFrame) -> DataFrame:
    """(lang, word, n) over labelled (lang, text)."""

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in got:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lang in sorted(set(langs)):
                for chars, _, _ in batches([t for t, x in zip(texts, langs) if x == lang]):
                    starts, ends = word_spans(chars)
                    _, first, n = np.unique(chars.hashes(starts, ends), return_index=True, return_counts=True)
                    raw = chars.codes.astype("<u4").tobytes()
                    words = [raw[4 * s : 4 * e].decode("utf-32-le") for s, e in zip(starts[first].tolist(), ends[first].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words)), pa.array(words, pa.string()), pa.array(n.astype(np.int64))], ["lang", "word", "n"])

    return labelled.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, vocabulary: str | None = None, fit_rows: int = FIT_ROWS, iterations: int = ITERATIONS) -> Model:
    """Fit on about fit_rows rows a language of those that are labelled and not held out, drawn by a hash of doc_id."""
    lighter_batches(docs.sparkSession)
    pieces_list = read_pieces(vocabulary or default_vocabulary())
    pieces = Pieces(pieces_list)
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    share = usable.groupBy("lang").agg(F.least(F.lit(1.0), fit_rows / F.count("*")).alias("share"))  # a row a language
    usable = usable.join(F.broadcast(materialise(share, "lang-shares")), "lang")
    chosen = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    counts = materialise(_word_counts(usable.where(chosen).select("lang", "text")), "lang-words")
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    prob = np.full((pieces.n + 1, len(langs)), 1.0 / pieces.n)
    prob[-1] = 0.0
    for _ in range(iterations if langs else 0):
        sent = docs.sparkSession.sparkContext.broadcast((langs, pieces, prob))

        def run(got: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            langs, pieces, prob = sent.value
            total = np.zeros((pieces.n, len(langs)))
            for b in _gathered(got):
                lang = np.array(b.column(0).to_pylist(), dtype=object)
                words, n = b.column(1).to_pylist(), b.column(2).to_numpy()
                for k in sorted(set(lang)):
                    at = np.flatnonzero(lang == k)
                    for i in range(0, len(at), 20_000):
                        some = [words[a] for a in at[i : i + 20_000]]
                        ends = np.cumsum([len(w) + 1 for w in some]) - 1
                        starts = ends - [len(w) for w in some]
                        c = langs.index(k)
                        total[:, c] += expected_counts(Chars("\n".join(some)), starts, ends, n[at[i : i + 20_000]], pieces, prob[:, c : c + 1])
            piece, c = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[piece, c])], ["l", "piece", "n"])

        # languages x pieces rows at most; rounded, so that the order of summing does not show
        rows = counts.mapInArrow(run, "l int, piece int, n double").groupBy("l", "piece").agg(F.sum(F.col("n").cast("decimal(28,6)")).cast("double").alias("n")).toPandas()
        prob = np.full((pieces.n + 1, len(langs)), SMOOTHING)
        prob[rows["piece"], rows["l"]] += rows["n"]
        prob[-1] = 0.0
        prob /= prob.sum(0)
    return Model(langs, pieces, prob)


def score_texts(texts: list[str | None], model: Model, kept: Kept | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihoods (texts, languages) and the number of letter runs of each text."""
    kept = kept or Kept(len(model.langs))
    total, n_words = np.zeros((len(texts), len(model.langs))), np.zeros(len(texts), dtype=np.int64)
    for chars, rows, parts in batches(texts):
        starts, ends = word_spans(chars)
        if not len(starts):
            continue
        words, first, at = np.unique(chars.hashes(starts, ends), return_index=True, return_inverse=True)
        each, known = kept.get(words)
        new = np.flatnonzero(~known)
        if len(new):
            each[new] = word_likelihoods(chars, starts[first[new]], ends[first[new]], model.pieces, model.prob)
            kept.put(words[new], each[new])
        each = each[at]
        owner = np.array(rows)[np.searchsorted(parts, starts, side="right") - 1]
        for k in range(len(model.langs)):
            total[:, k] += np.bincount(owner, each[:, k], minlength=len(texts))
        n_words += np.bincount(owner, minlength=len(texts))
    return total, n_words


def decide(texts: list[str | None], model: Model, kept: Kept | None = None) -> tuple[list[str], np.ndarray]:
    """Predicted language of each text and its posterior with all languages as likely."""
    if not model.langs:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    total, n = score_texts(texts, model, kept)
    known = np.array([k > 0 and any(c.isalpha() for c in t) for k, t in zip(n, texts)], dtype=bool)
    odds = np.exp(total - total.max(1, keepdims=True))
    return [model.langs[k] if ok else UNKNOWN for k, ok in zip(total.argmax(1), known)], np.where(known, 1 / odds.sum(1), 0.0)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score; columns of these names are replaced."""
    lighter_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = without(docs, "lang_pred", "score")
    at = docs.columns.index("text")

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Kept(max(1, len(sent.value.langs)))
        for b in small_batches(got):
            lang, score = decide(b.column(at).to_pylist(), sent.value, kept)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score)], [*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *StructType.fromDDL("lang_pred string, score double").fields]))


def identify(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, fitted on the table's own labelled rows that are not held out."""
    model = fit(docs, **options)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def drop_unknown(docs: DataFrame, least_score: float = 0.5, **options) -> DataFrame:
    """docs less the rows without a letter and those of no clear language."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, **options))
    at = docs.columns.index("text")

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Kept(max(1, len(sent.value.langs)))
        for b in small_batches(got):
            lang, score = decide(b.column(at).to_pylist(), sent.value, kept)
            yield b.filter(pa.array([x != UNKNOWN and p >= least_score for x, p in zip(lang, score)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
