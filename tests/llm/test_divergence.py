import re
from collections import Counter, defaultdict

import numpy as np

from streamloom.llm import divergence

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def plain(rows, least=10, top=10, unit=10**9):
    """The same straight from the definition, term by term."""
    counts, docs, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for r in rows:
        lang, source = r["lang"] or "", r["source"] or ""
        text = (r["text"] or "").translate(str.maketrans(LETTERS, LETTERS.lower()))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)
        sources[lang].add(source)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, own in sources.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def weights(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + unit * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        of = {s: weights(counts[lang, s]) for s in own}
        whole = weights(sum((counts[lang, s] for s in own), Counter()))
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in own:
            pairs = [(o, sum(f(of[s][t], of[o][t]) for t in kept)) for o in own if o != s]
            terms = [(t, f(of[s][t], whole[t])) for t in kept if counts[lang, s][t] and of[s][t] > whole[t]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(items[:limit])]
    return sorted(out)


def same(got, rows, **options):
    assert sorted(map(tuple, got.collect())) == plain(rows, **options)


def test_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    same(divergence.audit(docs), docs.collect())
    same(divergence.audit(docs, least_docs=2, top=3, unit=997), docs.collect(), least=2, top=3, unit=997)


def test_odd_rows(spark):
    texts = [None, "", "12 34", "Été éTÉ the THE İ ẞ", "a b 漢字 x_y", "the cat the cat", "a b c " * 5000, "zz " * 7 + "漢字"]
    rows = [(k, t, lang, source, "x", 1) for k, (t, lang, source) in enumerate((t, la, s) for t in texts for la in (None, "", "en", "zz") for s in ("s", None, "", "t"))]
    rows += [(500, "solo only", "one", "lone", "x", 1), (501, None, None, None, None, None), (502, "never kept here", "bare", "p", "", 0), (503, None, "bare", "q", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, term string, n long")
    same(divergence.audit(docs), docs.collect())
    same(divergence.audit(docs, least_docs=1), docs.collect(), least=1)
    assert divergence.audit(docs.where("false")).count() == 0
    # a language whose groups have no kept term has pairs of value 0
    assert [tuple(r)[3:] for r in divergence.audit(docs).where("lang = 'bare'").orderBy("source").collect()] == [("q", 0, 1), ("p", 0, 1)]


def test_a_hot_source_and_terms_over_many_blocks(spark):
    rng = np.random.default_rng(5)
    words = [f"w{chr(97 + a)}{chr(97 + b)}{chr(97 + c)}" for a in range(20) for b in range(20) for c in range(8)]
    rows = [(k, " ".join(np.array(words)[(rng.zipf(1.3, 200) - 1) % len(words)]), "en", "hot" if k % 3 else f"s{k % 60}") for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    same(divergence.audit(docs, least_docs=3), docs.collect(), least=3)


def test_tiles_of_levels_give_one_table():
    counts = np.random.default_rng(6).integers(0, 40, (300, 5))
    totals = counts.sum(0).tolist()
    each = Counter()
    for tile in (3, 40, 512):
        sums = Counter()
        for g, h, v in divergence.joint_prices(counts, totals, 300, 10**9, tile):
            sums[g, h] += v
        each[tuple(sorted(sums.items()))] += 1
    assert len(each) == 1
    p = [divergence.weights(counts[:, g], totals[g], 300, 10**9) for g in range(5)]
    assert dict(next(iter(each))) == {(g, h): int(divergence.price(p[g], p[h]).sum()) for g in range(5) for h in range(g + 1, 5)}


def test_counts_beyond_64_bits_in_between():
    p = divergence.weights(np.array([4 * 10**10, 1]), 8 * 10**10, 2, 10**9)
    assert p.tolist() == [1 + 10**9 * (4 * 10**10 + 2) // (8 * 10**10 + 4), 1 + 10**9 * 3 // (8 * 10**10 + 4)]


def test_a_long_text_is_split_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "SPLIT_AT_ONCE", 10)
    for text in ("abc de " * 9, "a" * 50 + " b", "", "  ", "é" * 30):
        assert [t for some in divergence.terms_of(text) for t in some] == text.encode().split()
