import random
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import DOCS, awkward
from pyspark.sql import functions as F

from quillon.llm import divergence as D
from quillon.llm.oracles import ORACLES
from quillon.llm.queries import QUERIES

sys.path.insert(0, "tests")
from compare import compare, connect  # noqa: E402


def brute(rows, least=3, top=200):
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups[lang].add(source)
        counts[lang, source].update(found)
        seen[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= least]
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}

        def p(count, n):
            return 1 + 10**9 * (count + 1) // (n + len(kept))

        for s in sources:
            pairs = [(o, sum((p(counts[lang, s][t], total[s]) - p(counts[lang, o][t], total[o]))**2
                             // p(counts[lang, o][t], total[o]) for t in kept))
                     for o in sources if o != s]
            terms = []
            for t in kept:
                a = p(counts[lang, s][t], total[s])
                q = p(sum(counts[lang, o][t] for o in sources), sum(total.values()))
                if counts[lang, s][t] and a > q:
                    terms.append((t, (a - q)**2 // q))
            for part, found, cut in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:cut]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def table(spark, rows, **extra):
    made = [(i, t, lang, source, None) for i, (lang, source, t) in enumerate(rows)]
    return spark.createDataFrame(made, DOCS).withColumns({k: F.lit(v) for k, v in extra.items()})


def made(seed=3, n=150):
    rng = random.Random(seed)
    words = ["The", "the", "größe", "東京", "x-ray", "é", "a1b", "Z", "ßß", "ÀB", *(
        f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80))]
    rows = [(rng.choice(["en", "en", "en", "de", None]), f"s{rng.choice([0, 0, 0, 1, 2, 3, 4])}",
             " ".join(rng.choices(words, k=rng.randint(0, 60)))) for _ in range(n)]
    rows += [("xx", "only", "a a a"), ("yy", "p", ""), ("yy", "q", None), ("en", None, "the the"),
             ("en", "empty", "12 34"), ("en", "", None), ("zz", "é", "b"), ("zz", "z", "b"),
             ("zz", "ž", "b c")]
    return rows + [("en", "s1", t) for _, t in awkward(3000)]


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("block_terms", [5, 32_768])
def test_against_brute_force(spark, block_terms):
    rows = made()
    df = D.audit(table(spark, rows, term="x", n=1, block=2, size=3), block_terms=block_terms)
    assert got(df) == brute(rows)
    assert df.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"),
                         ("item", "string"), ("value", "bigint"), ("rank", "int")]


def test_few_ranks_flushes_and_shuffled_lookups(spark, monkeypatch):
    monkeypatch.setattr(D, "SHARED_ROWS", 0)
    rows = made(9, 60)
    assert got(D.audit(table(spark, rows), 2, 3)) == brute(rows, 2, 3)
    assert D.audit(table(spark, [])).count() == 0


def test_counts_leave_tasks_when_many_are_held(spark):
    name = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    rows = [("en", f"s{i % 2}", f"common x{name(i)} y{name(i)}") for i in range(2000)]
    partial = D.term_counts(table(spark, rows).coalesce(1), 500)
    total = partial.agg(F.sum("n"), F.sum("docs"), F.count_if(F.col("term") == "common")).first()
    assert total[:2] == (3 * 2000, 3 * 2000) and total[2] >= 8


def test_arrays_survive_packing():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 5000):
        ids = np.sort(rng.choice(40_000, n, replace=False)).astype(np.int64)
        counts = rng.integers(1, 2**rng.integers(1, 62), n) if n else np.zeros(0, np.int64)
        back = D.unpack(D.pack(ids, counts))
        assert (back[0] == ids).all() and (back[1] == counts).all()
    assert len(D.unpack(None)[0]) == 0


def test_gallop_finds_every_place():
    rng = np.random.default_rng(2)
    for few, many in ((0, 5), (5, 0), (3, 9000), (2000, 2500), (700, 700)):
        a = np.unique(rng.integers(0, 10_000, few))
        b = np.unique(rng.integers(0, 10_000, many))
        assert (D.gallop(a, b) == np.searchsorted(b, a)).all()


def test_shares_are_exact_at_large_counts(spark):
    cases = [(0, 0, 1), (2 * 10**13, 3 * 10**13, 10**9), (5, 17, 4), (10**12, 10**12, 1)]
    frame = spark.createDataFrame(cases, "c long, t long, k long")
    sql = [r[0] for r in frame.select(D.share(F.col("c"), F.col("t"), F.col("k"))).collect()]
    want = [1 + 10**9 * (c + 1) // (t + k) for c, t, k in cases]
    assert sql == want
    assert [int(D.shares(np.array([c]), t, k)[0]) for c, t, k in cases] == want


def test_query_equals_its_statement(spark):
    sf = "/root/testdata/sf0.01"
    assert compare(QUERIES["op11_pair_merge"](spark, sf), connect(sf),
                   ORACLES["op11_pair_merge"]) is None
