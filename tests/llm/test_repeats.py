import hashlib
import random
import sys

import pyarrow as pa
import pytest
from helpers import awkward, docs

from pyspark.sql import functions as F

from quillon.llm import repeats
from quillon.llm.oracles import ORACLES
from quillon.llm.queries import QUERIES

sys.path.insert(0, "tests")
from compare import compare as statement  # noqa: E402
from compare import connect  # noqa: E402


def brute(rows, window):
    """What is left, by looking up every window of every document."""
    last = 2**63 - 1
    split = [(last if i is None else i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, w in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k: k + window])
            least[key] = min(i, least.get(key, last))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if least[tuple(w[k: k + window])] < i:
                gone[k: k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((None if i == last else i, len(w), sum(gone),
                    hashlib.sha256(kept).hexdigest()))
    return out


def same(got, want):
    plain = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got]
    assert sorted(plain, key=str) == sorted(want, key=str)


def planted(seed, n=60):
    rng = random.Random(seed)
    draw = lambda k: [rng.choice("abcdefgé") * rng.randint(1, 3) for _ in range(k)]
    passages = [draw(rng.choice([49, 50, 51, 60, 120])) for _ in range(8)]
    rows = []
    for i in range(n):
        words = draw(rng.randint(0, 90))
        for _ in range(rng.choice([0, 1, 1, 2])):
            p = rng.choice(passages)
            a = rng.randint(0, 8)
            words += p[a: len(p) - rng.randint(0, 8)] + draw(rng.randint(0, 30))
        rows.append((i * 3 % (n + 1), rng.choice([" ", "\n", " \t"]).join(words)))
    rows += [(n + 5, rows[3][1]), (n + 6, rows[3][1]), (n + 7, "x " + "same " * 200),
             (n + 8, "same " * 55), (n + 9, "same " * 49)]
    return rows


@pytest.mark.parametrize("window, phrase", [(50, 8), (10, 3)])
def test_planted_passages(spark, monkeypatch, window, phrase):
    monkeypatch.setattr(repeats, "SHARD_BYTES", 4000)
    rows = planted(window)
    got = repeats.report(docs(spark, rows, phrase=1, shard="x", t=None), window, phrase).collect()
    want = brute(rows, window)
    assert sum(r[2] for r in want) > 500
    same(got, want)


def test_awkward_rows(spark):
    rows = awkward()
    long = " ".join(f"k{i}" for i in range(70))
    rows += [(None, long), (None, long), (20, long), (20, long), (19, "z " + long)]
    same(repeats.report(docs(spark, rows)).collect(), brute(rows, 50))
    assert repeats.report(docs(spark, [])).count() == 0


def test_query_against_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"])
            for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    same(QUERIES["op3_repeated_phrases"](spark, sf).collect(), brute(rows, 50))


def test_remove_keeps_columns_and_other_text(spark):
    long = "\n".join(f"k{i}" for i in range(60))
    frame = docs(spark, [(1, long), (2, f"head\t{long}  tail\nend"), (3, None)], t=4)
    got = {r["doc_id"]: r for r in repeats.remove(frame).collect()}
    assert repeats.remove(frame).columns == frame.columns
    assert got[1]["text"] == long and got[3]["text"] is None
    assert got[2]["text"] == "head\ttail\nend"


def test_the_automaton_decides(spark, monkeypatch):
    """Places that the automaton does not report are not looked at."""
    import ahocorasick

    passage = [f"p{i}" for i in range(80)]
    texts = pa.table({"id": [1, 2], "t": [5, 6], "shard": [0, 0],
                      "text": [" ".join(passage), "x y " + " ".join(passage) + " z"]})
    rows = [(1, texts["text"][0].as_py()), (2, texts["text"][1].as_py())]
    frame = spark.createDataFrame(texts)
    runs = [r["phrases"] for r in repeats.features(docs(spark, rows), 50, 8).collect()]
    both = sorted(set(runs[0]) & set(runs[1]))
    frame = frame.withColumn("phrases", F.array(*[F.lit(p) for p in both]))
    spans = repeats._spans(frame, 50, 8).collect()
    confirmed = [{"phrase": r["phrase"], "p": r["p"], "s1": r["s1"], "s2": r["s2"], "least": [1]}
                 for r in spans if r["id"] == 2]
    kept = {}
    for skip in (False, True):
        with monkeypatch.context() as patch:
            original = ahocorasick.Automaton
            patch.setattr(ahocorasick, "Automaton", lambda: FakeOf(original, skip))
            kept[skip] = repeats.search_shard(texts, pa.Table.from_pylist(confirmed), 50, 8, False)
    gone = {skip: dict(zip(t["id"].to_pylist(), t["n_removed"].to_pylist()))
            for skip, t in kept.items()}
    assert gone[False][2] >= 50 and gone[False][1] == 0
    assert gone[True] == {1: 0, 2: 0}


class FakeOf:
    """An automaton that reports everything or nothing."""

    def __init__(self, real, skip):
        self.real, self.skip = real(), skip
        self.add_word, self.make_automaton = self.real.add_word, self.real.make_automaton

    def __len__(self):
        return len(self.real)

    def iter(self, line):
        return iter(()) if self.skip else self.real.iter(line)


def test_ids_that_repeat_or_are_large(spark):
    long = [f"k{i}" for i in range(70)]
    last = 2**63 - 1
    rows = [(7, " ".join(long[:60] + [f"n{i}"] * 3)) for i in range(40)] + [
        (7, " ".join(long)), (3, " ".join(long[5:])), (last, " ".join(long)), (None, " ".join(long))]
    rows += [(None, " ".join(long + [f"m{i}"])) for i in range(30)] + [(7, " ".join(long))] * 5
    same(repeats.report(docs(spark, rows)).collect(), brute_named(rows, 50))


def brute_named(rows, window):
    out = brute(rows, window)
    return [(rows[k][0], *r[1:]) for k, r in enumerate(out)]


def test_query_equals_its_statement(spark):
    sf = "/root/testdata/sf0.01"
    assert statement(QUERIES["op3_repeated_phrases"](spark, sf), connect(sf), ORACLES["op3_repeated_phrases"]) is None
