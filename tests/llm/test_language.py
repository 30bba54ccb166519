import itertools
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from streamloom.llm import language
from streamloom.llm.textarrays import Chars

SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def model(spark):
    return language.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), fit_rows=300)


NAMES = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "abbaabbaabbaabb"]


def segmentations(word, p):
    """Every way to cut a word, with its weight and the share of each piece in it."""
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
        ways = [(1.0, ())]
        for i, j in zip(at, at[1:]):
            s, own = word[i:j], []
            if i == 0:
                own += [(p.get("▁" + s, 0.0), ("▁" + s,)), (p["▁"] * p.get(s, 0.0), ("▁", s))]
            else:
                own.append((p.get(s, 0.0), (s,)))
            if j == i + 1:
                own.append((language.FLOOR, ()))
            ways = [(w * v, used + more) for w, used in ways for v, more in own if v]
        yield from ways


def table(words):
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    return Chars("\n".join(words)), ends - [len(w) for w in words], ends


@pytest.mark.parametrize("short", [32, 0])
def test_sums_and_expectations_over_every_segmentation(monkeypatch, short):
    """By length and one by one, against all cuts written out."""
    monkeypatch.setattr(language, "SHORT", short)
    monkeypatch.setattr(language, "STRETCH", 3)
    pieces = language.Pieces(NAMES)
    assert pieces.longest == 15
    prob = np.vstack([np.random.default_rng(0).random((len(NAMES), 2)), np.zeros((1, 2))])
    words, n = ["abba", "a", "bab", "ccab", "abbaabbaabbaabb"], np.array([3, 1, 2, 5, 1])
    got = language.word_likelihoods(*table(words), pieces, prob)
    for k in range(2):
        p = dict(zip(NAMES, prob[:, k]))
        ways = [list(segmentations(w, p)) for w in words]
        totals = [sum(w for w, _ in own) for own in ways]
        assert np.allclose(got[:, k], np.log(totals))
        expect = dict.fromkeys(NAMES, 0.0)
        for own, total, times in zip(ways, totals, n):
            for w, used in own:
                for s in used:
                    expect[s] += times * w / total
        counts = language.expected_counts(*table(words), n, pieces, prob[:, k : k + 1])
        assert np.allclose(counts, [expect[s] for s in NAMES])


def test_long_words_equal_the_sums_by_length(monkeypatch):
    pieces = language.Pieces(language.read_pieces(language.default_vocabulary()))
    prob = np.vstack([np.random.default_rng(1).dirichlet(np.ones(pieces.n), 3).T, np.zeros((1, 3))])
    words = ["internationalisation", "donaudampfschifffahrtsgesellschaft", "a" * 31, "слово" * 6]
    monkeypatch.setattr(language, "SHORT", 40)
    one = language.word_likelihoods(*table(words), pieces, prob)
    monkeypatch.setattr(language, "SHORT", 5)
    assert np.allclose(language.word_likelihoods(*table(words), pieces, prob), one)
    assert np.isfinite(language.word_likelihoods(*table(["ab" * 30_000]), pieces, prob)).all()


def plain_fit(rows, names, longest, rounds):
    """Piece probabilities by language from dictionaries: forward-backward a word."""
    langs = sorted({lang for lang, _ in rows})
    words = {lang: Counter() for lang in langs}
    for lang, text in rows:
        words[lang].update(regex.findall(r"[\p{L}\p{M}]+", text.lower()))
    known, prob = set(names), {lang: dict.fromkeys(names, 1 / len(names)) for lang in langs}

    def weight(p, w, i, j):
        v = p.get(w[i:j], 0.0)
        return (p.get("▁" + w[i:j], 0.0) + p["▁"] * v if i == 0 else v) + (language.FLOOR if j == i + 1 else 0.0)

    def sums(p, w):
        a, b = [1.0] + [0.0] * len(w), [0.0] * len(w) + [1.0]
        for j in range(1, len(w) + 1):
            a[j] = sum(a[i] * weight(p, w, i, j) for i in range(max(0, j - longest), j))
        for i in range(len(w) - 1, -1, -1):
            b[i] = sum(weight(p, w, i, j) * b[j] for j in range(i + 1, min(len(w), i + longest) + 1))
        return a, b

    for _ in range(rounds):
        for lang in langs:
            p, n = prob[lang], dict.fromkeys(names, language.SMOOTHING)
            for w, times in words[lang].items():
                a, b = sums(p, w)
                for i in range(len(w)):
                    for j in range(i + 1, min(len(w), i + longest) + 1):
                        outer, s = times * a[i] * b[j] / a[-1], w[i:j]
                        if i == 0 and "▁" + s in known:
                            n["▁" + s] += outer * p["▁" + s]
                        if s in known:
                            n[s] += outer * p[s] * (p["▁"] if i == 0 else 1.0)
                            n["▁"] += outer * p[s] * p["▁"] if i == 0 else 0.0
            total = sum(n.values())
            prob[lang] = {s: x / total for s, x in n.items()}
    return langs, {lang: lambda w, p=prob[lang]: sums(p, w)[0][-1] for lang in langs}


def test_the_query_equals_a_plain_version(spark):
    """Learning, words, sums, decision and score of every row, all in dictionaries."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.substring("text", 1, 400).alias("text"), "lang").where("doc_id % 4 = 0")
    rows = docs.collect()
    names = language.read_pieces(language.default_vocabulary())
    longest = max(len(s.removeprefix("▁")) for s in names)
    aside = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    langs, likelihood = plain_fit([(r["lang"], r["text"]) for r in rows if not aside(r["doc_id"])], names, longest, 2)
    got = {r["doc_id"]: r for r in language.identify(docs, iterations=2).collect()}
    assert len(got) == len(rows)
    for r in rows:
        words = regex.findall(r"[\p{L}\p{M}]+", r["text"].lower())
        logs = [sum(np.log(likelihood[lang](w)) for w in words) for lang in langs]
        g = got[r["doc_id"]]
        assert g["held_out"] == aside(r["doc_id"])
        assert g["lang_pred"] == (langs[int(np.argmax(logs))] if words else "und")
        assert g["score"] == pytest.approx(1 / sum(np.exp(x - max(logs)) for x in logs) if words else 0.0, rel=1e-4, abs=1e-9)


def test_a_rare_language_is_learned_beside_a_hot_one(spark):
    rows = [(i, "the cat sat on the mat and then it ran", "en") for i in range(3000)] + [(5000 + i, "der hund und die katze sind nicht hier", "de") for i in range(8)]
    model = language.fit(spark.createDataFrame(rows, SCHEMA), fit_rows=20, iterations=2)
    assert model.langs == ["de", "en"]


def test_words_kept_by_a_task_change_nothing():
    pieces = language.Pieces(NAMES)
    model = language.Model(["x", "y"], pieces, np.vstack([np.random.default_rng(0).random((len(NAMES), 2)), np.zeros((1, 2))]))
    kept = language.Kept(2)
    kept.bits = 2
    kept.keys, kept.values, kept.full = kept.keys[:4], kept.values[:4], kept.full[:4]
    texts = ["ab ba abb", "b ab a bb aab abab", "ab", None, "aa ab b"] * 3
    for k in range(0, 15, 4):
        assert np.allclose(language.score_texts(texts[k : k + 4], model, kept)[0], language.score_texts(texts[k : k + 4], model)[0])


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.predict(docs, model).where(language.held_out(F.col("doc_id"))).collect()
    assert len(rows) > 150
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    known = [r for r in rows if r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == r["lang"] for r in known) >= 0.97 * len(known)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows(spark, model):
    rows = [(1, None, "en"), (2, "", None), (3, "123 !!", "en"), (4, "x" * 100_000, "en"), (None, "The the and", None), (5, "日本語", "en")]
    df = spark.createDataFrame([(*r, "z") for r in rows], SCHEMA + ", Score string")
    got = {r["doc_id"]: r for r in language.predict(df, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[3]["score"] == 0.0
    assert got[4]["lang_pred"] in model.langs and got[None]["lang_pred"] == "en"
    kept = language.drop_unknown(df.union(df))
    assert kept.columns == df.columns
    nothing = language.identify(spark.createDataFrame([(1, "abc", None)], SCHEMA)).collect()
    assert nothing[0]["lang_pred"] == "und"
    assert language.identify(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_fit_does_not_depend_on_the_order_of_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a, b = language.fit(docs, iterations=2), language.fit(docs.orderBy("text"), iterations=2)
    assert a.langs == b.langs and np.allclose(a.prob, b.prob, rtol=1e-6)


def test_a_word_of_any_length_is_one_word():
    """A word longer than a batch counts as a whole, as its likelihood by itself does, and memory of a stretch is bounded by the languages too."""
    pieces = language.Pieces(language.read_pieces(language.default_vocabulary()))
    prob = np.vstack([np.random.default_rng(2).dirichlet(np.ones(pieces.n), 2).T, np.zeros((1, 2))])
    model = language.Model(["a", "b"], pieces, prob)
    word = "internationalisation" * 15_000
    own = language.word_likelihoods(*table([word]), pieces, prob)[0]
    total, n = language.score_texts([f"{word} 12", None, "a"], model)
    assert n.tolist() == [1, 0, 1] and np.allclose(total[0], own)
    many = language.LongWord(Chars(word), 0, len(word), pieces, np.zeros((pieces.n + 1, 500)))
    assert many.stretch * pieces.longest * 500 <= language.STRETCH_WEIGHTS
