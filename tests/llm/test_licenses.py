import random
import re
import sys

import duckdb
import pandas as pd
import pytest
from helpers import awkward, docs

from quillon.llm import licenses
from quillon.llm.oracles import ORACLES
from quillon.llm.queries import QUERIES

sys.path.insert(0, "tests")
from compare import compare, connect  # noqa: E402


def brute(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    base, labels, best = [], set(), 0.0
    for t in licenses.templates():
        key, body = t["key"], t["body"]
        for i in range(len(words) - len(key) + 1):
            if words[i: i + len(key)] == key:
                o = i - t["start"]
                share = sum(0 <= o + k < len(words) and words[o + k] == w
                            for k, w in enumerate(body)) / len(body)
                if share >= licenses.SHARE:
                    labels.add(t["label"])
                    best = max(best, share)
                    if t["base"]:
                        base.append((o, t["label"]))
    return (len(words), len(base), min(base)[0] if base else None, max(base)[0] if base else None,
            ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), pytest.approx(best))


def same(got, rows):
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    left = sorted(((r["doc_id"], tuple(r[n] for n in names)) for r in got), key=str)
    right = sorted(((i, brute(t)) for i, t in rows), key=lambda r: str((r[0], tuple(
        getattr(v, "expected", v) for v in r[1]))))
    assert [x[0] for x in left] == [x[0] for x in right]
    for (_, a), (_, b) in zip(left, right, strict=True):
        assert a == b


def made(n=120):
    rng = random.Random(4)
    parts = [t["body"] for t in licenses.templates()]
    rows = []
    for i in range(n):
        words = rng.choices(["the", "of", "license", "mit", "public", "é", "cc", "4"],
                            k=rng.randint(0, 40))
        for _ in range(rng.choice([0, 1, 2])):
            body = list(rng.choice(parts))
            if rng.random() < 0.4:
                body[rng.randrange(len(body))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = body[rng.choice([0, 0, 1, 3]):]
        sep = rng.choice([" ", "-", ". ", "\n"])
        rows.append((i, sep.join(rng.choice([w, w.upper(), w.title()]) for w in words)))
    return rows


def test_against_brute_force(spark):
    rows = made() + awkward() + [(500, "MIT License " * 3000), (501, "mit license")]
    same(licenses.scan(docs(spark, rows, words=1, row="x", t=2)).collect(), rows)
    assert licenses.scan(docs(spark, [])).count() == 0


def test_statement_on_made_rows(spark):
    rows = made()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    df = licenses.scan(docs(spark, rows))
    assert compare(df, con, ORACLES["op6_rare_token_index"]) is None


def test_query_equals_its_statement(spark):
    sf = "/root/testdata/sf0.01"
    df = QUERIES["op6_rare_token_index"](spark, sf)
    assert compare(df, connect(sf), ORACLES["op6_rare_token_index"]) is None
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rarest_words_are_indexed(spark):
    rows = [(i, "license version public") for i in range(20)] + [(50, "apache license version 2 0")]
    seen = licenses._words_of(docs(spark, rows), licenses.templates())
    idf = licenses.rarity(seen)
    assert idf["apache"] > idf["license"]
