import time

from streamloom.llm.decontamination import find
from streamloom.llm import decontamination as d
from streamloom.llm import textarrays

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def brute(docs, items):
    out = {}
    for i, t in docs:
        words = d.tokens(t)
        for k, s in items:
            own = d.tokens(s)
            n = min(5, len(own))
            if n and i is not None:
                q = d.shingles(own, n)
                c = len(q & d.shingles(words, n)) / len(q)
                if c >= 0.8:
                    out.setdefault(i, {})[k] = c
    return out


def found(df):
    return {r["doc_id"]: {f["item_id"]: f["containment"] for f in r["found"]} for r in df.collect() if r["found"]}


def test_equals_brute_force_on_the_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    passages = [(900 + i, " ".join(rows[i][1].split()[40 : 60 + i])) for i in range(30)]
    edited = [(950 + i, " ".join("zz" if j == 3 + i else w for j, w in enumerate(t.split()))) for i, (_, t) in enumerate(passages)]
    every = items + passages + edited
    expect = brute(rows, every)
    assert len(expect) >= 30
    assert found(d.find(docs, every)) == expect
    out = d.contamination(docs, spark.createDataFrame(every, ITEMS))
    assert out.count() == len(rows)
    assert {r["doc_id"] for r in out.where("contaminated").collect()} == set(expect)
    assert {r["doc_id"] for r in d.drop_contaminated(docs, spark.createDataFrame(every, ITEMS)).collect()} == {i for i, _ in rows} - set(expect)


def test_blocks_of_items_give_the_same(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = spark.createDataFrame([(i, " ".join(rows[i][1].split()[:30])) for i in range(40)], ITEMS)
    one = sorted(map(str, d.contamination(docs, items).collect()))
    monkeypatch.setattr(d, "BLOCK_BYTES", 2000)
    assert sorted(map(str, d.contamination(docs, items).collect())) == one


def test_short_items_long_texts_and_odd_rows(spark):
    filler = " ".join(f"w{i}" for i in range(400_000))
    docs = [(1, filler + " The quick, BROWN fox! jumps over it " + filler), (2, None), (3, ""), (None, "x y z"), (4, "three short words"), (4, "three short words")]
    items = [(1, "the quick brown fox jumps over it"), (2, "short words"), (3, None), (4, ""), (5, "nothing like this"), (5, "three short"), (None, "x y z")]
    df = spark.createDataFrame([(*r, "e") for r in docs], DOCS + ", found string")
    got = found(d.find(df, [x for x in items if x[0] is not None]))
    assert got == {1: {1: 1.0}, 4: {2: 1.0, 5: 1.0}}
    kept = d.drop_contaminated(df, spark.createDataFrame(items, ITEMS))
    assert kept.columns == df.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 2, 3]
    empty = spark.createDataFrame([], ITEMS)
    assert d.contamination(df, empty).where("contaminated").count() == 0
    assert d.contamination(spark.createDataFrame([], DOCS), empty).count() == 0


def test_one_or_many_blocks_judge_each_row_by_its_own_text(spark, monkeypatch):
    leaks = [" ".join(f"w{i}x{k}" for k in range(12)) for i in range(20)]
    docs = [(None, leaks[0]), (None, "clean words of a row without an id"), (7, leaks[1] + " and " + leaks[2]), (7, "clean words of the same id"), (8, leaks[3])]
    items = [(i, t) for i, t in enumerate(leaks)] + [(3, leaks[3])]
    df, benchmark = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    one = sorted(map(str, d.contamination(df, benchmark).collect()))
    monkeypatch.setattr(d, "BLOCK_BYTES", 300)
    got = d.contamination(df, benchmark).collect()
    assert sorted(map(str, got)) == one
    assert sorted((str(r["doc_id"]), r["item_ids"]) for r in got) == [("7", []), ("7", [1, 2]), ("8", [3, 3]), ("None", []), ("None", [0])]


def test_an_item_anywhere_in_a_long_text_of_tabs(spark):
    """Pieces of long texts are cut between words whatever stands between them."""
    item = "a plain question about the long way home and back"
    for gap in ("\t", "\u00a0", "/", "_"):
        word = f"filler{gap}"
        rows = [(k, word * ((textarrays.BATCH_CHARS - 40) // len(word)) + "x" * k + gap + item.replace(" ", gap) + gap + word * 9) for k in range(0, 45, 9)]
        got = find(spark.createDataFrame(rows, "doc_id long, text string"), [(7, item)]).collect()
        assert all([f["item_id"] for f in r["found"]] == [7] for r in got)


def test_words_of_any_length(spark):
    """A word longer than a batch is one word, in items and in documents; hashing it takes linear time."""
    word = "".join(chr(97 + (i * i) % 26) for i in range(300_000))
    assert len(word) > textarrays.BATCH_CHARS
    items = [(1, f"one two {word} three four"), (2, word), (3, word[:-1] + "!")]
    docs = spark.createDataFrame(
        [(1, f"said one two {word} three four and more"), (2, f"x{word}"), (3, f"a {word.upper()}, b"), (4, word[:200_000]), (5, "q " * 200_000 + word + " z"), (6, f"{word[:150_000]} {word[150_000:]}")],
        "doc_id long, text string",
    )
    found = {r["doc_id"]: sorted(x["item_id"] for x in r["found"]) for r in find(docs, items).collect()}
    assert found == {1: [1, 2], 2: [], 3: [2], 4: [], 5: [2], 6: []}
    assert [len(p) for p in textarrays.pieces("ab " * 10 + "x" * 50 + " cd", 8)][-2:] == [51, 2]
    began = time.time()
    for n in (50_000, 400_000):
        assert textarrays.span_hash(word[:1] * n) == textarrays.span_hash(word[:1] * n)
    assert time.time() - began < 5
    short = "some letters"
    assert textarrays.span_hash(short * 9) == sum((ord(c) + 1) * pow(int(textarrays.BASE), i, 1 << 64) for i, c in enumerate(short * 9)) % (1 << 64)
