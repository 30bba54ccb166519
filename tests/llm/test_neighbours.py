import numpy as np
import pytest

from streamloom.llm import neighbours as nn

SCHEMA = "vec_id long, embedding array<float>"


def brute(ids, x, k=5, every=50):
    x = np.asarray(x, dtype=np.float64)
    norms = np.sqrt((x * x).sum(1))
    out = {}
    for at in [i for i, v in enumerate(ids) if v % every == 0]:
        s = (x * x[at]).sum(1) / (norms * norms[at])
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[at]][:k]
        out[ids[at]] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def rows_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("spread", [nn.SPREAD, 2.0])
def test_recall_on_a_whole_table(spark, spread):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = rows_of(nn.self_search(vectors, spread=spread))
    table = vectors.orderBy("vec_id").toPandas()
    expect = brute(table["vec_id"].to_numpy(), np.stack(table["embedding"]))
    assert set(got) == set(expect)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in expect[q]}) for q in expect)
    assert hits >= 0.9 * 5 * len(expect)
    scores = {(q, i): s for q in expect for i, s in expect[q]}
    assert all(scores[q, i] == pytest.approx(s, abs=1e-15) for q in got for i, s in got[q] if (q, i) in scores)


def test_the_loss_weighs_the_parallel_residual():
    x = np.random.default_rng(1).standard_normal((3000, 16))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    aware, plain = nn.Quantiser(16), nn.Quantiser(16)
    aware.extra, plain.extra = 8.0, 0.0
    lost = []
    for z in (aware, plain):
        z.fit(x)
        p = z.parts(x)
        lost.append((z._along(p, z.assign(p)) ** 2).mean())
    assert lost[0] < 0.6 * lost[1]


def test_packed_codes_give_the_decoded_products():
    x = np.random.default_rng(2).standard_normal((500, 7))
    z = nn.Quantiser(7).fit(x)
    (code, along, across), tables = z.encode(x), z.tables(x[:3])
    scores = sum(tables[:, b][:, code[:, b]] for b in range(code.shape[1]))
    decoded = np.concatenate([z.books[m, z.assign(z.parts(x))[:, m]] for m in range(z.m)], 1)
    assert np.allclose(scores, z.parts(x[:3]).reshape(3, -1) @ decoded.T, atol=1e-5)
    rest = z.parts(x).reshape(500, -1) - decoded
    assert np.allclose(along, (rest * z.parts(x).reshape(500, -1)).sum(1)) and np.allclose(along**2 + across**2, (rest**2).sum(1))


def test_copies_ties_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    one = rng.standard_normal(6).tolist()
    rows = [(i, one) for i in range(300)] + [(300 + i, rng.standard_normal(6).tolist()) for i in range(200)]
    odd = [(1000, None), (1050, [0.0] * 6), (1100, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1150, [float("nan")] * 6), (1200, [1.0, 2.0]), (None, one), (1250, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows + odd], SCHEMA + ", score int").repartition(3)
    got = rows_of(nn.self_search(df))
    assert set(got) == set(range(0, 500, 50))
    assert [i for i, _ in got[50]] == [0, 1, 2, 3, 4] and [i for i, _ in got[0]] == [1, 2, 3, 4, 5]
    few = rows_of(nn.self_search(spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (3, [0.0, 1.0])], SCHEMA)))
    assert few == {0: [(3, 0.0)]}
    assert nn.self_search(spark.createDataFrame([], SCHEMA)).collect() == []


def test_blocks_of_queries_give_the_same(spark, monkeypatch):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    one = rows_of(nn.self_search(vectors, every=7))
    monkeypatch.setattr(nn, "QUERY_BLOCK", 20)
    assert rows_of(nn.self_search(vectors, every=7)) == one


def test_batches_do_not_matter_and_near_copies_are_all_ranked(spark):
    """A third of the rows are near copies of one vector, with equal codes; batches of any size find the same, exactly with a certain spread."""
    rng = np.random.default_rng(5)
    near = rng.standard_normal(32)
    x = np.concatenate([near + 1e-3 * rng.standard_normal((2000, 32)), rng.standard_normal((4000, 32))])[rng.permutation(6000)].astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA).coalesce(2)
    expect = brute(np.arange(len(x)), x)
    key, results = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(key)
    try:
        for rows in ("10000", "1000", "200"):
            spark.conf.set(key, rows)
            results.append(rows_of(nn.self_search(df)))
        exact = rows_of(nn.self_search(df, spread=31**0.5))
    finally:
        spark.conf.set(key, before)
    assert results[0] == results[1] == results[2]
    assert {q: [i for i, _ in r] for q, r in exact.items()} == {q: [i for i, _ in r] for q, r in expect.items()}
    hits = sum(len({i for i, _ in results[0][q]} & {i for i, _ in expect[q]}) for q in expect)
    assert hits >= 0.99 * 5 * len(expect)


def test_components_of_any_size_and_repeated_ids(spark):
    rows = [(0, [1e-200, 2e-200]), (1, [1e200, 2e200]), (2, [3.0, -1.0]), (50, [5e-324, 0.0]), (4, [-1.0, 0.5])] + [(3, [1.0, 1.0])] * 8 + [(0, [float(i), 1.0]) for i in range(1, 9)]
    got = rows_of(nn.self_search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    # id 0 asks with its least vector; its own other rows are none of its neighbours, id 3 is one neighbour
    assert [(i, pytest.approx(s)) for i, s in got[0]] == [(1, 1.0), (3, 3 / 10**0.5), (50, 0.2**0.5), (2, 1 / 50**0.5), (4, 0.0)]
    assert [(i, pytest.approx(s)) for i, s in got[50]] == [(0, i / (i * i + 1) ** 0.5) for i in range(8, 3, -1)]
