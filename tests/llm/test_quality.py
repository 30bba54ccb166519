from collections import Counter, defaultdict

import numpy as np
import pytest

from streamloom.llm import quality

DOCS, LABELS = "doc_id long, text string, lang string", "doc_id long, quality int, toxic int"


def units(text):
    raw = text.encode("utf-16-le", "surrogatepass")
    return (32,) * (quality.ORDER - 1) + tuple(int.from_bytes(raw[i : i + 2], "little") for i in range(0, len(raw), 2))


def plain_model(texts):
    """Modified Kneser-Ney by dictionaries: a function from an n-gram to the probability of its last unit."""
    counts = [Counter() for _ in range(quality.ORDER + 1)]
    for t in texts:
        own = units(t)
        for i in range(len(own) - quality.ORDER + 1):
            counts[quality.ORDER][own[i : i + quality.ORDER]] += 1
    for k in range(quality.ORDER - 1, 0, -1):
        for g in counts[k + 1]:
            counts[k][g[1:]] += 1
    discounts = []
    for c in counts[1:]:
        n = [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        discounts.append([min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.1), k - 0.05) if n[k - 1] else 0.5 for k in (1, 2, 3)])
    sums = [defaultdict(int) for _ in counts]
    freed = [defaultdict(float) for _ in counts]
    for k in range(1, quality.ORDER + 1):
        for g, v in counts[k].items():
            sums[k][g[:-1]] += v
            freed[k][g[:-1]] += discounts[k - 1][min(v, 3) - 1]

    def p(g):
        lower = p(g[1:]) if len(g) > 1 else 1 / 65536
        k, v = len(g), counts[len(g)].get(g, 0)
        if g[:-1] not in sums[k]:
            return lower
        return (v - discounts[k - 1][min(v, 3) - 1] if v else 0.0) / sums[k][g[:-1]] + freed[k][g[:-1]] / sums[k][g[:-1]] * lower

    return p


def plain_perplexity(p, text):
    own = units(text)
    return np.exp(-np.mean([np.log(p(own[i : i + quality.ORDER])) for i in range(len(own) - quality.ORDER + 1)]))


@pytest.mark.parametrize("least", [100, 1])
def test_every_row_equals_the_plain_model(spark, small, monkeypatch, least):
    """Perplexities, limits and decisions of two languages, with all trusted documents taught and with a fold held out."""
    monkeypatch.setattr(quality, "LEAST_TRUSTED", least)
    monkeypatch.setattr(quality, "BLOCK_BYTES", 50_000)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang").where("lang in ('fr', 'de') and length(text) < 6000")
    odd = spark.createDataFrame([(900_001, "日本語の文章です。" * 9, "fr"), (900_002, "𝒳𝒴 \ud800".encode("utf-16", "surrogatepass").decode("utf-16", "replace") * 5, "de")], DOCS)
    docs = docs.unionByName(odd)
    labels = spark.read.parquet(f"{small}/labels.parquet")
    good = {r[0] for r in quality.trusted(labels).collect()}
    aside = {r[0] for r in docs.where(quality.held_out(docs["doc_id"])).collect()} if least == 1 else set()
    rows = docs.collect()
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == len(rows)
    for lang in ("fr", "de"):
        own = [r for r in rows if r["lang"] == lang]
        p = plain_model([r["text"] for r in own if r["doc_id"] in good - aside])
        expect = {r["doc_id"]: plain_perplexity(p, r["text"]) for r in own}
        for i, x in expect.items():
            assert got[i]["perplexity"] == pytest.approx(x, rel=1e-6)
        sample = sorted(x for i, x in expect.items() if i in good and (least == 100 or i in aside))
        low, high = sample[0] / quality.MARGIN, sample[-1] * quality.MARGIN
        for i, x in expect.items():
            assert got[i]["low"] == pytest.approx(low, rel=1e-6) and got[i]["high"] == pytest.approx(high, rel=1e-6)
            assert got[i]["keep"] == (low <= x <= high)
        assert sum(p((101, 32, 100, c)) for c in range(65536)) == pytest.approx(1.0)


def test_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r["doc_id"]: r["keep"] for r in quality.classify(docs, labels).collect()}
    rows = {r["doc_id"]: r for r in labels.collect()}
    clean = [got[i] for i, r in rows.items() if r["quality"] == 1 and r["toxic"] == 0]
    poor = [got[i] for i, r in rows.items() if r["quality"] == 0]
    assert sum(clean) >= 0.99 * len(clean)
    assert sum(poor) <= 0.1 * len(poor)


def test_odd_rows(spark):
    rows = [(1, "some plain good text here " * 9, "en"), (2, None, "en"), (3, "", "en"), (4, " \n", "en"), (5, "bon", "fr"), (6, "x", None), (7, "plain " * 300_000, "en"), (1, "some plain good text here " * 9, "en"), (None, "text", "en")]
    df = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", perplexity int")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, None), (6, 1, 0), (5, 0, 0), (None, 1, 0)], LABELS)
    got = quality.classify(df, labels).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["perplexity"] for i in (2, 3, 4, 5)] == [None] * 4
    assert [by[i]["keep"] for i in (1, 2, 3, 4, 5, 6)] == [True, False, False, False, True, True]
    assert by[6]["lang"] is None and by[7]["perplexity"] > 0
    empty = spark.createDataFrame([], DOCS)
    assert quality.classify(empty, labels).collect() == []
    assert quality.classify(df, spark.createDataFrame([], LABELS)).where("perplexity is not null").count() == 0


def test_blocks_give_the_same(spark, small, monkeypatch):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    rounded = lambda: sorted((r["doc_id"], round(r["perplexity"] or 0, 9), r["keep"]) for r in quality.classify(docs, labels).collect())
    one = rounded()
    monkeypatch.setattr(quality, "HELD_BYTES", 1000)
    monkeypatch.setattr(quality, "_SLOT_BITS", 8)
    assert rounded() == one


def test_seen_lets_every_gram_through_once_at_least():
    seen, rng = quality.Seen(), np.random.default_rng(1)
    out = {}
    for _ in range(20):
        for group in ("a", "b"):
            g = rng.integers(0, 3000, 500).astype(np.uint64)
            out.setdefault(group, set()).update(seen.new(group, g).tolist())
            assert set(g.tolist()) <= out[group]
