import random
from itertools import combinations

import corpus_pipeline
from streamloom.llm import neardup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_set(text):
    words = (text or "").lower().split()
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def plain_kept(rows):
    """The ids that stay: the smallest of each component of texts with a five-word Jaccard similarity of 0.8."""
    label, sets = {i: i for i, _ in rows}, {i: plain_set(t) for i, t in rows}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in combinations(label, 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            a, b = sorted((top(a), top(b)))
            label[b] = a
    return sorted({top(i) for i in label})


def kept(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], SCHEMA)
    return corpus_pipeline.near_duplicates(spark, docs, None)


def test_stage_equals_brute_force_on_the_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    expect = plain_kept([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, small).collect()) == expect


def test_copies_around_the_limit_and_a_common_line(spark, monkeypatch):
    draw = random.Random(1)
    prose = lambda n: [f"w{draw.randrange(5000)}" for _ in range(n)]
    line, rows = prose(12), []
    for _ in range(12):  # texts with one to eight changed words of 150, similarity from 0.97 down to 0.6
        base = prose(150)
        for edits in range(9):
            words = list(base)
            for at in draw.sample(range(150), edits):
                words[at] = "changed"
            rows.append((len(rows), " ".join(words)))
    hub = prose(100)
    for _ in range(60):  # a large group, of which some link to few others
        words = list(hub)
        for at in draw.sample(range(100), draw.randrange(4)):
            words[at] = f"x{draw.randrange(9)}"
        rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + i, " ".join(line + prose(20))) for i in range(80)]
    draw.shuffle(rows)
    expect = plain_kept(rows)
    assert 100 < len(expect) < len(rows) - 60
    assert sorted(r["doc_id"] for r in kept(spark, rows).collect()) == expect
    monkeypatch.setattr(neardup, "MAX_COMMON", 0)  # the order changes no result, nor does a merge instead of a broadcast
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", 0)
    assert sorted(r["doc_id"] for r in kept(spark, rows).collect()) == expect


def test_bitmaps_reject_no_alike_pair():
    draw = random.Random(3)
    for n in (1, 4, 9, 90, 3000):
        for _ in range(20):
            base = [f"w{draw.randrange(9000)}" for _ in range(n + 4)]
            other = [w if draw.random() > 0.02 else "x" for w in base]
            a, b = (neardup.shingle_set(" ".join(t)) for t in (base, other))
            apart = sum((x ^ y).bit_count() for x, y in zip(neardup.bitmap(a), neardup.bitmap(b)))
            assert not neardup.alike(a, b) or 9 * apart <= len(a) + len(b)


def test_odd_rows(spark):
    rows = [(5, None), (4, ""), (3, " \n"), (None, "same words"), (9, "Same  words"), (8, "same words"), (8, "same words"), (8, "other words"), (None, "no id"), (None, "no id")]
    got = sorted(((r["doc_id"], r["text"]) for r in kept(spark, rows).collect()), key=str)
    assert got == sorted([(3, " \n"), (8, "same words"), (8, "other words"), (None, "no id")], key=str)
    assert kept(spark, []).count() == 0
    clash = spark.createDataFrame([(1, "a b c", 5, 6), (2, "a b c", 7, 8)], "doc_id long, text string, row int, _doc int")
    assert [tuple(r) for r in neardup.keep_one(clash).collect()] == [(1, "a b c", 5, 6)]
