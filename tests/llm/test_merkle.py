import zlib
from hashlib import sha256

import pytest

from streamloom.llm import merkle

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text):
    return digest(*map(field, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
    return out


def path_of(tree, i):
    """Node numbers of the siblings before and after, level by level."""
    out = []
    for level in tree[:-1]:
        first = i // 16 * 16
        out.append(("".join(level[first:i]), "".join(level[i + 1 : first + 16])))
        i //= 16
    return out


def plain(rows):
    """Every row's proof from whole trees in memory."""
    trees = {}
    for r in rows:
        trees.setdefault(r["source"], []).append((leaf(r, r["text"]), r))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        trees[s].sort(key=lambda x: (x[1]["doc_id"] is not None, x[1]["doc_id"] or 0, x[0]))
    of = {s: levels([x for x, _ in trees[s]]) for s in order}
    top = levels([of[s][-1][0] for s in order])
    root, out = top[-1][0], []
    for j, s in enumerate(order):
        for i, (own, r) in enumerate(trees[s]):
            path = path_of(of[s], i) + path_of(top, j)
            now = own
            if r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                now = leaf(r, r["text"].translate(str.maketrans(LETTERS, LETTERS.lower())))
            for before, after in path:
                now = digest(before, now, after)
            out.append((r["doc_id"], own, of[s][-1][0], root, digest(*[x for pair in path for x in pair]), now, now == root))
    return sorted(out, key=str)


def same(docs, **options):
    got = merkle.verify(docs, **options)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs.collect())


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 300, 4095, 4096])
def test_positions_are_those_of_completion(n):
    leaves = [str(i) for i in range(n)]
    for top in {merkle.height(n), 3}:
        nodes = merkle.build_segment(leaves, top)
        rows = [leaves]
        for _ in range(top):
            rows.append([digest(*rows[-1][k : k + 16]) for k in range(0, len(rows[-1]), 16)])
        assert len(nodes) == sum(map(len, rows))
        assert merkle.levels_of(nodes, n, top) == rows


def test_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    same(docs)
    same(docs, levels=1)


def test_a_hot_source_over_several_rounds(spark):
    rows = [(k, f"Text {k}", "en", "hot" if k % 3 else f"s{k % 40}", k) for k in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    same(docs, levels=1)
    same(docs)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None, 1), (None, "A", "en", None, 1, 1), (5, "B", None, "", 1, 2), (5, "B", None, "", 1, 2), (5, "C", None, "", 1, 2), (-7, "D" * 100_000, "é", "é", None, 3), (11, "no capital", "en", "z", 3, 4), (12, "", "", "z", 0, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, hash long")
    same(docs)
    same(docs.limit(1))
    assert merkle.verify(docs.where("false")).count() == 0
    assert merkle.Manifest(docs.where("false")).root is None


def test_proofs_lead_to_the_root(spark, small):
    made = merkle.Manifest(spark.read.parquet(f"{small}/documents.parquet"))
    rows = made.proofs().collect()
    assert len(rows) == made.leaves.count()
    assert all(merkle.fold(r["hash"], r["path"]) == made.root for r in rows)
    assert not any(merkle.fold(r["hash"][::-1], r["path"]) == made.root for r in rows)
