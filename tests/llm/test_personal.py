import hashlib
import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from streamloom.llm import personal as p
from streamloom.llm import queries

SCHEMA = "doc_id long, text string"
PLAIN = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def plain(text):
    out = []
    for k, (name, pattern) in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if name == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if name == "card":
                s = [int(c) for c in digits][::-1]
                if not 14 <= len(digits) <= 19 or (sum(s[::2]) + sum(sum(divmod(2 * d, 10)) for d in s[1::2])) % 10:
                    continue
            if name == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a@b.c", "x_", "@", ".", "1.2.3.4", "256", "4111 1111-1111 1111", "+1 (274) 555-9629", "+", "-", " ", "12", "d@e.f-g", "é", "(", "0", "\n"]), max_size=14).map("".join))
def test_base_spans_equal_the_plain_expressions(text):
    assert p.base_spans(text) == plain(text)


def test_pathological_texts_take_linear_time():
    for text in ("1" * 300_000, "a." * 200_000, "1 " * 200_000, "+1" + "." * 200_000, "a@" * 100_000, "1." * 200_000):
        p.base_spans(text)
        p.others(text, [])


def test_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = {r["doc_id"]: r for r in p.digest(p.extract(docs)).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(rows) == set(texts)
    found = 0
    for i, r in rows.items():
        base = plain(texts[i])
        found += len(base)
        assert r["base_sha256"] == hashlib.sha256(p.joined(base).encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(p.joined(base).split(",") if base else []) <= set(spans)
        for k in p.KINDS:
            assert r[f"n_{k}"] == sum(s.startswith(k + ":") for s in spans)
    assert found > 5


def test_contexts_discover_unseen_identifiers(spark):
    rng = random.Random(1)
    filler = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n))
    rows = [(i, f"{filler(9)} contact me at user{i}@mail{i % 7}.example.com today {filler(6)}") for i in range(40)]
    rows += [(100 + i, f"{filler(9)} contact me at hidden{i}(at)host{i} today {filler(6)}") for i in range(4)]
    rows += [(200 + i, f"{filler(5)} version build {i}0{i}1 was {filler(6)}") for i in range(30)]
    got = {r["doc_id"]: r for r in p.digest(p.extract(spark.createDataFrame(rows, SCHEMA))).collect()}
    for i in range(4):
        text = dict(rows)[100 + i]
        at = text.index("hidden")
        assert got[100 + i]["spans"] == f"email:{at}:{at + len(f'hidden{i}(at)host{i}')}" and got[100 + i]["n_email"] == 1
    assert all(got[200 + i]["spans"] == "" for i in range(30))
    assert all(got[i]["n_email"] == 1 for i in range(40))


def plain_additions(seen, rounds=p.ROUNDS):
    """(row, start, kind, end) that the pattern graph adds, in plain loops over the tokens of all rows."""
    edges, seed_of = Counter(), {}
    for _, s in seen:
        for pattern in s["patterns"]:
            edges[pattern, s["value"]] += 1
            if s["kind"] is not None:
                seed_of[pattern, s["value"]] = max(s["kind"], seed_of.get((pattern, s["value"]), -1))
    totals, instances = Counter(), Counter()
    for (pattern, _), n in edges.items():
        totals[pattern] += n
        instances[pattern] += 1
    seeds = {(value, kind): 1.0 for (_, value), kind in seed_of.items()}
    scores = dict(seeds)
    for _ in range(rounds):
        own = Counter()
        for (pattern, value), n in edges.items():
            for (v, kind), score in scores.items():
                if v == value:
                    own[pattern, kind] += n * score
        sure = {}
        for (pattern, kind), n in own.items():
            if instances[pattern] >= p.LEAST_INSTANCES and n / (totals[pattern] + p.DAMPING) >= p.PATTERN_SCORE:
                sure[pattern, kind] = n / (totals[pattern] + p.DAMPING)
        miss = {}
        for (pattern, value) in edges:
            for kind in range(len(p.KINDS)):
                if (pattern, value) not in seed_of and (pattern, kind) in sure:
                    miss[value, kind] = miss.get((value, kind), 1.0) * (1.000001 - sure[pattern, kind])
        new = {}
        for (value, kind), m in miss.items():
            if 1 - m >= p.INSTANCE_SCORE and (value not in new or (1 - m, -kind) > (new[value][1], -new[value][0])):
                new[value] = (kind, 1 - m)
        scores = {**seeds, **{(value, kind): score for value, (kind, score) in new.items()}}
    added = {(row, s["start"], kind, s["end"]) for row, s in seen if s["kind"] is None for q in s["patterns"] for kind in range(len(p.KINDS)) if (q, kind) in sure and (s["value"], kind) in scores}
    return {a for a in added if not any(b != a and b[0] == a[0] and b[2] == a[2] and b[1] <= a[1] and a[3] <= b[3] for b in added)}


def test_pattern_graph_equals_plain_loops(spark, small):
    rng = random.Random(3)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    rows = []
    for i in range(120):
        words = [rng.choice(["call", "mail", "pay", "see", "to", "at"]) for _ in range(6)]
        for _ in range(3):
            words.insert(rng.randrange(6), rng.choice([f"u{i % 9}@m.example.com", f"u{i % 5}(at)host", f"10.0.{i}.1", f"+1 (555) 555-{number(4)}", "4111 1111 1111 1111", "4111111111111111", number(16), f"v{i % 4}.{i % 3}"]))
        rows.append((i, " ".join(words)))
    rows += [(1000 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    docs = spark.createDataFrame(rows, SCHEMA)
    seen = [(r["doc_id"], s) for r in p.survey(docs).collect() for s in r["seen"]]
    got = {(r["doc_id"], s["start"], s["kind"], s["end"]) for r in p.extract(docs).collect() for s in set(r["spans"]) - set(r["base"])}
    assert got == plain_additions(seen) and len(got) > 10


def test_numbers_next_to_each_other_are_found_again(spark):
    card, wrong = "4524132264652876", "4524132264652877"
    cards = [n for n in range(4_524_132_264_600_000, 4_524_132_264_600_400) if p.luhn(str(n))]
    rows = [(1000 + i, f"some words +1 (2{i:02d}) 555-{i:04d} and {c} here") for i, c in enumerate(cards)]
    rows += [(2000 + i, f"other prose +44 20 7946 0{i:02d}8 and more") for i in range(20)]
    rows += [(50, f"x +1 (269) 555-3296 {card} y"), (51, f"x +1 (843) 555-7672 170.106.47.218 y"), (52, f"x {wrong} {wrong} y"), (53, f"x {card} {card} y"), (54, f"+44 20 7946 0458 {card}")]
    texts = dict(rows)
    got = {r["doc_id"]: {(s["kind"], texts[r["doc_id"]][s["start"] : s["end"]]) for s in set(r["spans"]) - set(r["base"])} for r in p.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[50] == {(3, "+1 (269) 555-3296"), (2, card)}
    assert got[51] == {(3, "+1 (843) 555-7672")} and got[52] == set() and got[53] == {(2, card)}
    assert got[54] == {(3, "+44 20 7946 0458"), (2, card)}
    assert all(not got[i] for i in got if i >= 1000)


def test_contexts_have_whole_words():
    long = "w" * 100_000
    text = f"{long} \"= at: a@b.cd,x@y.zz !! {long} 1.2.3.4"
    spans = [(s, e) for s, _, e in p.base_spans(text)]
    first, second, third = p.contexts(text, spans)
    digest = hashlib.md5(long.encode()).hexdigest()
    assert f"< {digest} at" in first and f"< {digest} at" in second
    assert f"<> at _ {digest}" in second and len(third) == 2 and third[1].endswith(digest)
    assert first[0] == "= a@a.a" and third[0] == "= 0.0.0.0"


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a@b.cd " * 20_000), (4, "x 10.0.0.1 y"), (4, "x 10.0.0.1 y"), (None, "+1 (274) 555-9629")]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", spans int")
    got = p.digest(p.extract(df)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["spans"] == "" and by[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by[3]["n_email"] == 20_000 and by[4]["spans"] == "ip:2:10" and by[None]["n_phone"] == 1
    assert p.digest(p.extract(spark.createDataFrame([], SCHEMA))).collect() == []


def test_the_query_counts_base_spans(spark, tmp_path):
    """What the method adds stands in spans and n_added only; counts are the base expressions', like base_sha256."""
    rows = [(i, f"alpha beta contact me at user{i}@mail{i % 7}.example.com today gamma") for i in range(40)]
    rows += [(100 + i, f"alpha gamma contact me at hidden{i}(at)host{i} today beta") for i in range(4)]
    rows += [(200, f"x {'0' * 5000}1.2.3.{'0' * 5000} and 256.1.1.1 y"), (201, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op8_personal_data(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        base = plain(text or "") if i != 200 else [(2, 1, 10_008)]
        assert [got[i][f"n_{k}"] for k in p.KINDS] == [sum(s[1] == k for s in base) for k in range(4)]
        assert got[i]["base_sha256"] == hashlib.sha256(p.joined(base).encode()).hexdigest()
    assert all(got[100 + i]["spans"].startswith("email:") and got[100 + i]["n_added"] == 1 for i in range(4))
