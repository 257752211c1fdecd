import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import awkward, docs

from quillon.llm import labelled, quality, toxicity
from quillon.llm.queries import QUERIES


def truth(spark, sf, name):
    return {r["doc_id"]: r[name] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}


@pytest.mark.parametrize("query, name, modulus, held, least", [
    ("op7_toxicity", "toxic", 5, 0, 0.9), ("op10_quality", "quality", 4, 2, 0.95)])
def test_held_out_accuracy(spark, query, name, modulus, held, least):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES[query](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == held)
        assert 0 <= r["score"] <= 1
    known = truth(spark, sf, name)
    right = [known[r["doc_id"]] == r["predicted"] for r in rows
             if r["held_out"] and r["doc_id"] in known]
    assert np.mean(right) >= least


@pytest.mark.parametrize("kind", [toxicity, quality])
def test_awkward_rows(spark, kind):
    rows = awkward()
    frame = docs(spark, rows, score=1, y="z", held_out=None)
    labels = spark.createDataFrame(
        [(1, 1), (4, 1), (4, 1), (5, 0), (6, 0), (6, None), (None, 1), (99, 1)],
        "doc_id long, toxic int").withColumnRenamed("toxic", "quality").selectExpr(
        "doc_id", "quality", "quality toxic")
    model = kind.fit(frame, labels)
    got = kind.score(frame, model).collect()
    assert len(got) == len(rows)
    by_text = {}
    for (_, text), r in zip(sorted(rows, key=str), sorted(got, key=lambda r: r["score"]), strict=True):
        assert 0 <= r["score"] <= 1
    for r in got:
        by_text.setdefault(r["doc_id"], set()).add(round(r["score"], 12))
    assert by_text[1] == by_text[2] and len(by_text[4]) == 1
    judged = labelled.judged(kind.score(frame, model), 5, 0, 0.5).collect()
    assert all(r["held_out"] is False for r in judged if r["doc_id"] is None)


@pytest.mark.parametrize("kind", [toxicity, quality])
def test_no_labels_and_no_rows(spark, kind):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = kind.fit(docs(spark, [(1, "a b")]), none)
    assert kind.score(docs(spark, [(1, "a b")]), model).first()["score"] == pytest.approx(0.5)
    assert kind.score(docs(spark, []), model).count() == 0
    one = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    model = kind.fit(docs(spark, [(1, "a b")]), one)
    assert kind.score(docs(spark, [(2, "c")]), model).first()["score"] == pytest.approx(2 / 3)


def test_ngrams_are_those_of_the_text():
    def plain(text):
        return {n: [text[i: i + n] for i in range(len(text) - n + 1)] for n in toxicity.ORDERS}

    for text in [" a ", "  ", " größe 東京 "]:
        want = plain(text)
        got = list(toxicity.grams([" x y z ", text]))
        for n, (own, place) in zip(toxicity.ORDERS, got, strict=True):
            assert (own == 1).sum() == len(want[n])
            alone = list(toxicity.grams([text]))[toxicity.ORDERS.index(n)][1]
            assert (place[own == 1] == alone).all()


def test_gradient_of_the_attention_model():
    rng = np.random.default_rng(0)
    sizes, x = np.array([1, 3, 2]), rng.normal(size=(6, 4))
    y = np.array([0.0, 1.0, 1.0])
    w = {"E": rng.normal(size=(4, 3)), "e": rng.normal(size=3), "V": rng.normal(size=(3, 2)),
         "U": rng.normal(size=(3, 2)), "a": rng.normal(size=2), "c": rng.normal(size=3),
         "b": np.zeros(1)}

    def loss():
        p = quality._forward(w, x, sizes)[0]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grad = quality._gradient(w, x, sizes, y)
    for k, v in w.items():
        at = tuple(0 for _ in v.shape)
        v[at] += 1e-6
        up = loss()
        v[at] -= 2e-6
        down = loss()
        v[at] += 1e-6
        assert grad[k][at] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_keep_returns_whole_rows(spark):
    frame = docs(spark, awkward(), other=3)
    labels = spark.createDataFrame([(1, 1), (5, 0)], "doc_id long, quality int")
    model = quality.fit(frame, labels)
    assert quality.keep(frame, model, 0.0).collect() == frame.collect()
    assert quality.keep(frame, model, 1.1).count() == 0


def plain_passages(text):
    """Features of every passage, word by word and byte by byte."""
    words, at, data = [], [], (text or "").encode()
    for m in re.finditer(rb"[^\x20\x09-\x0D]+", data):
        words.append(m[0])
        at.append(m.start())
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    out, triples = [], set()
    for a in range(0, max(1, len(words)), quality.SPAN):
        mine, x = words[a: a + quality.SPAN], np.zeros(quality.WIDTH)
        if mine:
            end = at[a + len(mine)] if a + len(mine) < len(words) else at[-1] + len(words[-1])
            for b in data[at[a]: end]:
                kind = (1 if 48 <= b < 58 else 2 if 65 <= b < 91 else 3 if 97 <= b < 123
                        else 4 if b >= 128 else 5 + marks.index(b) if b in marks
                        else 5 + len(marks) if b == 10 else 0)
                x[kind] += 1
            c = 6 + len(marks)
            x[:c] /= x[:c].sum()
            sizes = np.array([len(w) for w in mine], float)
            again = sum(tuple(words[k: k + 3]) in triples or triples.add(tuple(words[k: k + 3]))
                        is not None for k in range(a, a + len(mine)))
            x[c:] = [sizes.mean() / 8, sizes.std() / 8, len(set(mine)) / len(mine),
                     sum(u == v for u, v in zip(mine, mine[1:])) / len(mine), again / len(mine),
                     len(mine) / quality.SPAN]
        out.append(x)
    return np.array(out)


def plain_score(model, text):
    x = np.clip((plain_passages(text) - model.mean) / model.scale, -8, 8)
    w, sigmoid = model.weights, lambda v: 1 / (1 + np.exp(-v))
    h = [np.tanh(row @ w["E"] + w["e"]) for row in x]
    attention = np.array([np.exp((np.tanh(v @ w["V"]) * sigmoid(v @ w["U"])) @ w["a"]) for v in h])
    z = sum(a * v for a, v in zip(attention / attention.sum(), h))
    return float(sigmoid(z @ w["c"] + w["b"][0]))


def test_quality_scores_against_a_plain_loop(spark, sf):
    """Texts of whole passages: the last two words of a slice have no triple of their own."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet")
            .orderBy("doc_id").limit(60).collect()]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs(spark, rows), model).collect()}
    for i, text in rows:
        assert got[i] == pytest.approx(plain_score(model, text), abs=0.02)
    close = [abs(got[i] - plain_score(model, text)) < 1e-9 for i, text in rows]
    assert np.mean(close) > 0.5


def test_a_score_does_not_depend_on_the_rows_beside_it(spark):
    text = "One two, three. " * 40
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    fitted = quality.fit(docs(spark, [(1, text), (2, "!!! ??? " * 90)]), labels)
    frame = docs(spark, [(1, text), (2, "  \n\n x"), (3, text), (4, " y" * 70), (5, text)]).coalesce(1)
    got = {r["doc_id"]: r["score"] for r in quality.score(frame, fitted).collect()}
    assert got[1] == got[3] == got[5]


def test_the_fit_sees_every_passage_of_a_document(spark):
    long = " ".join(f"w{i}" for i in range(70 * quality.SPAN))
    frame = docs(spark, [(1, long), (2, "one two"), (2, "other"), (3, long + " x"), (4, "a")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 5)], "doc_id long, quality int")
    whole = {r["doc_id"]: r["n"] for r in quality.bags(frame, labels, "quality", 99, 500).collect()}
    assert whole == {1: 70, 2: 1, 3: 71, 4: 1}
    some = {r["doc_id"]: r["n"] for r in quality.bags(frame, labels, "quality", 99, 72).collect()}
    assert sum(some.values()) <= 72 and set(some.values()) <= {1, 70, 71}
    assert quality.bags(frame, labels, "quality", 2, 500).count() == 2


def plain_places(text):
    """Hash places of all distinct n-grams, one n-gram at a time."""
    code, mask, out = [ord(c) + 1 for c in f" {(text or '').lower()} "], 2**64 - 1, set()
    for n in toxicity.ORDERS:
        for i in range(len(code) - n + 1):
            h = 0
            for c in code[i: i + n]:
                h = (h * 0x9E3779B97F4A7C15 + c) & mask
            out.add((((h ^ (h >> 29)) * 0xD1342543DE82EF95) & mask) >> (64 - toxicity.BITS))
    return out


def test_toxicity_against_plain_counts(spark):
    """Texts with each n-gram by plain counting, scores by plain sums of the model's weights."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(["Good", "bad", "fine", "ugly", "wörd"], 6))) for i in range(60)]
    known = {i: int("bad" in t and "ugly" in t) for i, t in rows}
    frame = docs(spark, rows)
    sample = spark.createDataFrame([(t, known[i]) for i, t in rows], "text string, y int")
    bad, good, texts = toxicity._counts(sample)
    assert texts.tolist() == [60 - sum(known.values()), sum(known.values())]
    for label, counts in ((1, bad), (0, good)):
        want = Counter(p for i, t in rows if known[i] == label for p in plain_places(t))
        assert {int(p): int(counts[p]) for p in np.flatnonzero(counts)} == want
    labels = spark.createDataFrame(list(known.items()), "doc_id long, toxic int")
    model = toxicity.fit(frame, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(frame, model).collect()}
    for i, text in rows:
        total = model.bias + sum(model.weight[model.slot[p]] for p in plain_places(text)
                                 if model.slot[p] >= 0)
        assert got[i] == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-9)


def test_a_struct_column_passes_through(spark):
    frame = docs(spark, [(1, "a b"), (2, "c")]).selectExpr(
        "*", "named_struct('a field', 1, 'b`c', 'x') as s")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    model = quality.fit(frame, labels)
    assert quality.keep(frame, model, 0.0).collect() == frame.collect()


def test_labelled_rows_are_bounded_where_an_id_repeats(spark):
    frame = docs(spark, [(1, f"text {i}") for i in range(500)] + [(2, "b")])
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert labelled.sample(frame, labels, "toxic", 10).count() == 2
