import hashlib
import random

import pytest

from streamloom.llm import repeats

SCHEMA = "doc_id long, text string"


def brute(rows):
    """rows of (doc_id, text): repeated 100-byte strings by a dictionary of all of them."""
    seen, out = set(), []
    for i, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0])):
        d = (t or "").encode()
        gone = bytearray(len(d))
        for s in range(len(d) - 99):
            w = d[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(g and not gone[k - 1] if k else bool(g) for k, g in enumerate(gone))
        out.append((i, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def rows_of(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("block_bytes", [repeats.BLOCK_BYTES, 40_000])
def test_whole_table(spark, small, block_bytes):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    expect = brute(rows)
    assert sum(r[2] > 0 for r in expect) > 10
    assert rows_of(repeats.remove_repeats(docs.repartition(5), block_bytes=block_bytes)) == sorted(expect, key=str)


def planted(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(rng.randint(10, 60)) for _ in range(6)] + ["ab" * 80, "x" * 250, "ab" * 49 + "c"]
    rows = []
    for i in range(120):
        rows.append((i, " ".join(rng.choice(passages) if rng.random() < 0.4 else prose(rng.randint(1, 30)) for _ in range(rng.randint(1, 6)))))
    return rows + [(200 + i, rows[i][1]) for i in range(0, 120, 3)] + [(400 + i, rows[i][1][5:-9] + "!") for i in range(0, 120, 5)]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize(("hot", "piece"), [(repeats.HOT, repeats.PIECE), (2, 300)])
def test_planted_passages_hot_names_and_pieces(spark, seed, hot, piece, monkeypatch):
    rows = planted(seed)
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "PIECE", piece)
    repeats._powers.cache_clear()
    # the steps one after the other, as tasks run them, so that the smaller limits hold
    ids = [i for i, _ in rows]
    import numpy as np
    import pyarrow as pa

    n_buckets, n_blocks = 3, 4
    shuffled = []
    for k in range(0, len(rows), 50):
        part = rows[k : k + 50]
        shuffled += repeats._name_batch(np.array([i for i, _ in part]), [t.encode() for _, t in part], n_buckets, n_blocks)

    def grouped(all_rows):
        out = {}
        for r in all_rows:
            out.setdefault(r[0], []).append(r)
        return out

    known = grouped(x for g in grouped(shuffled).values() for x in repeats._name_bucket(repeats._as_table(g), n_buckets, n_blocks))
    import zstandard

    got = {}
    blocks = repeats.block_of(np.array(ids), n_blocks)
    made = {}
    for b in range(n_blocks):
        own = [r for r, x in zip(rows, blocks) if x == b]
        docs = pa.table({"doc_id": [i for i, _ in own], "order": [i for i, _ in own], "blob": pa.array([zstandard.compress(t.encode()) for _, t in own], pa.binary())})
        made[b] = docs
    first = {}
    for b, docs in made.items():
        for n, d, p in zip(*repeats.Block(docs, repeats._as_table(known.get(b, []))).open_windows()):
            first[n] = min(first.get(n, (d, p, b)), (d, p, b))
    for b, docs in made.items():
        names = repeats.Block(docs, repeats._as_table(known.get(b, []))).open_windows()[0]
        lost = np.array([n for n in names if first[n][2] != b], dtype=np.uint64)
        table = repeats._as_table(known.get(b, []) + ([(b, repeats._LOST, repeats.pack(np.sort(lost)))] if len(lost) else []))
        for k, gone, text in repeats.Block(docs, table).removed():
            gone = np.zeros(len(text), dtype=bool) if gone is None else gone
            kept = bytes(x for x, g in zip(text, gone) if not g)
            got[docs.column("doc_id")[k].as_py()] = (int(gone.sum()), hashlib.sha256(kept).hexdigest())
    repeats._powers.cache_clear()
    assert got == {i: (n, h) for i, _, n, _, h in brute(rows)}


def test_planted_passages_through_spark(spark):
    rows = planted(3)
    assert rows_of(repeats.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(7), block_bytes=9000)) == sorted(brute(rows), key=str)


def test_odd_rows(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh ") for _ in range(400))
    rows = [(1, None), (2, ""), (3, long), (3, long), (4, "z" + long + long[:150]), (None, long), (5, "q" * 1_200_000), (6, "é" * 60)]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", blob int")
    got = rows_of(repeats.remove_repeats(df))
    expect = brute(rows)
    assert got == sorted([*expect, next(r for r in expect if r[0] == 3)], key=str)
    kept = {r["doc_id"]: r for r in repeats.remove_repeats(df, with_text=True).collect()}
    assert kept[3]["kept"].decode() == long and kept[None]["kept"] == b""
    assert repeats.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
