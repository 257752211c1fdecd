import random
import re
import sys
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from helpers import awkward, docs

from quillon.llm import spellings as S
from quillon.llm.oracles import ORACLES
from quillon.llm.queries import QUERIES

sys.path.insert(0, "tests")
from compare import compare, connect  # noqa: E402


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows, least_length=7, least_count=2):
    counts = Counter()
    for i, text in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), word)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 31 == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}
    found = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, others in found.items():
        if others:
            best = min(others, key=lambda v: (-words[v], v))
            if words[best] >= 10 * words[w]:
                form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(found[w]), words[form[w]] if w in form else None))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def made(seed=8, n=60):
    rng = random.Random(seed)
    stems = ["".join(rng.choices("abcdeé", k=rng.randint(6, 11))) for _ in range(30)]
    stems += ["aaaaaaa", "aaaaaaaa", "Aaaaaaab", "ÀÿÀÿÀÿÀ", "×÷ßßßßß", "zzzzzzzz", "ab" * 40, "ab" * 40 + "c",
              "ba" * 33, "ba" * 32 + "b"]

    def changed(word):
        word, i = list(word), rng.randrange(len(word))
        kind = rng.random()
        if kind < 0.1:
            word[i] = rng.choice("abcéz")
        elif kind < 0.2:
            word.insert(i, rng.choice("abcéz"))
        elif kind < 0.3:
            del word[i]
        return "".join(word)

    weights = [50 / (k + 1) ** 2 for k in range(len(stems))]
    return [(i, rng.choice([" ", ", ", "\n", "1"]).join(
        changed(rng.choices(stems, weights)[0]) for _ in range(rng.randint(0, 60))))
        for i in range(n)]


@pytest.mark.parametrize("slice_words", [1 << 24, 25])
def test_against_brute_force(spark, slice_words):
    rows = made() + awkward(3000) + [(None, "zzzzzzzz zzzzzzzy"), (3, "zzzzzzzz " * 40)]
    df = S.variants(docs(spark, rows, word="x", n=1, form="y"), slice_words=slice_words)
    want = brute(rows)
    assert got(df) == want
    assert sum(w[1] is not None for w in want) > 3
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_chains_of_forms_reach_their_root(spark):
    words = ["aaaaaaa", "aaaaaab", "aaaaabb", "aaaabbb", "aaabbbb"]
    judged = spark.createDataFrame([(w, words[i + 1] if i < 4 else None)
                                    for i, w in enumerate(words)], "word string, form string")
    from quillon.session import written

    found = S.roots(written(judged, "judged"))
    assert {tuple(r) for r in found.collect()} == {(w, "aaabbbb") for w in words[:4]}


def test_other_parameters_and_no_rows(spark):
    rows = made(3, 30)
    assert got(S.variants(docs(spark, rows), 5, 1)) == brute(rows, 5, 1)
    assert S.variants(docs(spark, [])).count() == 0
    assert S.variants(docs(spark, [(1, None), (2, "one two")])).count() == 0


def test_a_very_long_word(spark):
    long = "abcdefghij" * 3000
    rows = [(1, f"{long} {long} {long}x {long}x"), (2, f"{long} " * 3)]
    out = {r["word"]: r["n_near"] for r in S.variants(docs(spark, rows)).collect()}
    assert set(out.values()) == {1} and len(out) == 2


def test_filters_pass_every_member_and_few_others(spark):
    rng = random.Random(1)
    words = {"".join(rng.choices("abcdefghijklmn", k=rng.randint(7, 12))) for _ in range(20_000)}
    filters = S.build(spark.createDataFrame([(w,) for w in words], "word string"))
    others, passed, tried = 0, 0, 0
    for size, (_, points) in S.code_points(sorted(words)).items():
        assert len(filters.holds(size, S.polynomial(points))) == len(points)
    strange = ["".join(rng.choices("opqrstuvwxyz", k=9)) for _ in range(20_000)]
    for size, (_, points) in S.code_points(strange).items():
        passed += len(filters.holds(size, S.polynomial(points)))
        tried += len(points)
    assert passed < 0.01 * tried and others == 0
    assert filters.lanes.nbytes <= 2.2 * len(words) + 32 * 64


def test_edits_hash_like_the_words_they_spell():
    rng = np.random.default_rng(3)
    points = rng.choice(np.array([97, 98, 99, 0xE9], np.uint32), (50, 9))

    class All:
        def holds(self, length, sums):
            self.length, self.sums = length, sums
            return np.arange(len(sums))

    for edits in (S.deletions, lambda p, f, k: S.replacements(
            p, np.array([97, 98, 99, 0xE9], np.uint32), f, k)):
        tap, spelled = All(), []
        for _, words in edits(points, tap, lambda sums: slice(None)):
            spelled += words
        hashed = np.concatenate([S.polynomial(S.code_points([w])[len(w)][1]) for w in spelled])
        assert (hashed == tap.sums).all() and len(spelled) > 100


def test_statement_on_made_rows(spark):
    rows = [r for r in made(5) if r[1]]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    assert compare(S.variants(docs(spark, rows)), con, ORACLES["op13_bloom_edits"]) is None


def test_query_equals_its_statement(spark):
    sf = "/root/testdata/sf0.01"
    assert compare(QUERIES["op13_bloom_edits"](spark, sf), connect(sf),
                   ORACLES["op13_bloom_edits"]) is None
