import random
import sys

import pytest
from helpers import awkward, docs

from quillon.llm import near_duplicates as nd
from quillon.llm.graphs import components
from quillon.llm.oracles import ORACLES
from quillon.llm.queries import QUERIES

sys.path.insert(0, "tests")
from compare import compare as statement  # noqa: E402
from compare import connect  # noqa: E402


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i: i + size]) for i in range(len(words) - size + 1))


def brute(rows, size, percent):
    """component of each id by comparing all pairs of distinct sets."""
    sets = {}
    for i, text in rows:
        sets.setdefault(i, shingles(text, size))
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i)) for i in ids}


def compare(rows, got, size, percent):
    want = brute([r for r in rows if r[0] is not None], size, percent)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r
            assert r["kept"] == (r["doc_id"] == r["component_id"])
        else:
            assert r["component_id"] is None and r["kept"]


def edited(rng, words, share):
    return [rng.choice("qrstuvwxyz") * rng.randint(2, 9) if rng.random() < share else w
            for w in words]


def planted(seed, groups=6, copies=14, alone=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(900)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 150)))) for i in range(alone)]
    for _ in range(groups):
        source = rng.choices(vocabulary, k=rng.randint(40, 250))
        for _ in range(copies):
            text = " ".join(edited(rng, source, rng.choice([0, 0.005, 0.02, 0.04, 0.08])))
            rows.append((len(rows), rng.choice([text, text.upper()])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_planted_groups(spark, size, percent):
    rows = planted(size)
    got = nd.near_duplicates(docs(spark, rows, cid=1, key="x"), size, percent).collect()
    compare(rows, got, size, percent)


def test_one_large_group_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(nd, "PURE", 8)
    monkeypatch.setattr(nd, "CHUNK", 10)
    rows = planted(5, groups=1, copies=150, alone=5)
    got = nd.near_duplicates(docs(spark, rows), 3, 85).collect()
    compare(rows, got, 3, 85)


def test_awkward_rows(spark):
    rows = awkward()
    got = nd.near_duplicates(docs(spark, rows, n=1, comp=2, bands=3), 3, 85).collect()
    compare(rows, got, 3, 85)
    assert nd.near_duplicates(docs(spark, []), 3, 85).count() == 0


def test_query_against_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"])
            for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    compare(rows, QUERIES["op9_minhash"](spark, sf).collect(), 3, 85)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(170)]
    edges += [(1000 + i, 1001 + i) for i in range(60)]
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = top(a), top(b)
            parent[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["id"]: r["component"] for r in got} == {x: top(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_many_texts_under_one_id_take_rows_in_proportion(spark):
    """A third of all rows share an id; every class is read from its own row."""
    rows = planted(5, groups=6, copies=6, alone=40)
    rows = [(7 if k % 3 == 0 else i, t) for k, (i, t) in enumerate(rows)]
    frame = docs(spark, rows)
    seen = nd.features(frame, 3)
    classes = seen.filter("n_shingles > 0").selectExpr(
        "doc_id rep", "t", "d1", "d2", "monotonically_increasing_id() cid")
    assert nd._sets_of(frame, classes, 3).count() == seen.filter("n_shingles > 0").count()
    got = nd.near_duplicates(frame, 3, 85)
    assert got.count() == len(rows)


def test_one_of_each_decides_by_row(spark):
    rng = random.Random(2)
    text = " ".join(f"v{rng.randrange(500)}" for _ in range(80))
    near, other = text + " more", " ".join(f"u{i}" for i in range(40))
    rows = [(3, text), (7, near), (7, other), (7, other), (None, text), (None, "alone here now then so"),
            (None, "alone here now then so"), (9, ""), (9, None), (None, " "), (8, other)]
    got = nd.one_of_each(docs(spark, rows, group=1, t="x"))
    assert got.columns == docs(spark, rows, group=1, t="x").columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(
        [(3, text), (7, other), (None, "alone here now then so"), (9, ""), (9, None), (None, " ")],
        key=str)
    assert nd.one_of_each(docs(spark, [])).count() == 0


def test_query_equals_its_statement(spark):
    sf = "/root/testdata/sf0.01"
    assert statement(QUERIES["op9_minhash"](spark, sf), connect(sf), ORACLES["op9_minhash"]) is None
