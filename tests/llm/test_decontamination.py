import random
import re

import numpy as np
import pytest
from helpers import awkward, docs

from quillon.llm import decontamination as dc
from quillon.llm.queries import QUERIES


def plain(text):
    return re.sub(r"[!-/:-@\[-`{-~]", " ", text or "").encode().lower().split()


def greedy(item, text, least):
    """Textbook tiling: the longest free common run again and again."""
    used_i, used_t, covered = [False] * len(item), [False] * len(text), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for t in range(len(text)):
                k = 0
                while (i + k < len(item) and t + k < len(text) and item[i + k] == text[t + k]
                       and not used_i[i + k] and not used_t[t + k]):
                    k += 1
                if k > best[0]:
                    best = (k, i, t)
        k, i, t = best
        if k < least:
            return covered
        covered += k
        used_i[i: i + k] = used_t[t: t + k] = [True] * k


def brute(rows, items, least=5, share=0.5):
    out = []
    for doc_id, text in rows:
        words = plain(text)
        grams = {tuple(words[k: k + least]) for k in range(len(words) - least + 1)}
        for item_id, item in items:
            item = plain(item)
            if 0 < len(item) < least:
                if any(words[k: k + len(item)] == item for k in range(len(words))):
                    out.append((doc_id, item_id, len(item)))
            elif any(tuple(item[k: k + least]) in grams for k in range(len(item) - least + 1)):
                covered = greedy(item, words, least)
                if covered >= share * len(item):
                    out.append((doc_id, item_id, covered))
    return sorted(out, key=str)


def same(got, rows, items):
    assert sorted(((r["doc_id"], r["item_id"], r["covered_words"]) for r in got),
                  key=str) == brute(rows, items)
    by_id = dict(rows)
    of = dict(items)
    for r in got:
        assert r["coverage"] == pytest.approx(r["covered_words"] / r["item_words"])
        doc, item = plain(by_id[r["doc_id"]]), plain(of[r["item_id"]])
        for d, i, n in zip(r["tile_doc"], r["tile_item"], r["tile_words"], strict=True):
            assert doc[d: d + n] == item[i: i + n] and n >= min(5, len(item))


def made(seed):
    rng = random.Random(seed)
    draw = lambda k: [rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(k)]
    items = [(i, " ".join(draw(rng.randint(1, 40)))) for i in range(14)]
    rows = []
    for n in range(50):
        words = draw(rng.randint(0, 40))
        for _ in range(rng.choice([0, 1, 2])):
            item = rng.choice(items)[1].split()
            cut = rng.randint(0, len(item))
            kind = rng.random()
            part = (item if kind < 0.3 else item[cut:] + draw(2) + item[:cut] if kind < 0.6
                    else item[:cut])
            words = words + [w.upper() + rng.choice(["", ",", "."]) for w in part] + draw(3)
        rows.append((n, " ".join(words)))
    return rows, items


@pytest.mark.parametrize("block_words", [1 << 20, 60])
def test_planted_and_reordered(spark, block_words):
    rows, items = made(block_words)
    bench = spark.createDataFrame(items + items[:2], "item_id long, text string")
    got = dc.leaks(docs(spark, rows, item_id=9, coverage="x"), bench,
                   block_words=block_words).collect()
    assert len(got) > 10
    same(got, rows, items)
    left = dc.clean(docs(spark, rows, extra=1), bench, block_words=block_words)
    assert left.columns[-1] == "extra"
    assert {r["doc_id"] for r in left.collect()} == (
        {i for i, _ in rows} - {r["doc_id"] for r in got})


def test_awkward_rows(spark):
    rows = awkward()
    items = [(None, "no id here but long enough to tile"), (2, None), (3, ""), (4, "one"),
             (5, rows[-1][1][:400])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.leaks(docs(spark, rows), bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(4, 4), (4, 4), (6, 5)]
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.leaks(docs(spark, rows), none).count() == 0
    assert dc.leaks(docs(spark, []), bench).count() == 0
    assert dc.clean(docs(spark, rows), none).count() == len(rows)
    assert dc.clean(docs(spark, rows), bench).count() == len(rows) - 3


def test_short_items_leak_as_a_whole(spark):
    items = [(1, "The answer is four"), (2, "four"), (3, "is four, the"), (4, "is four"), (5, "--")]
    bench = spark.createDataFrame(items + items[:1], "item_id long, text string")
    rows = [(1, "the answer is four"), (2, "It is FOUR. The end is four"), (3, "answer is five"),
            (4, "is"), (5, "four"), (6, "the answer is"), (7, "four the answer is")]
    same(dc.leaks(docs(spark, rows), bench).collect(), rows, items)
    assert {r["doc_id"] for r in dc.clean(docs(spark, rows), bench).collect()} == {3, 4, 6}


def test_a_long_item_is_a_block_of_its_own(spark):
    rng = random.Random(1)
    long = " ".join(f"w{rng.randrange(3000)}" for _ in range(5000))
    items = [(0, long)] + [(i, " ".join(f"v{rng.randrange(900)}" for _ in range(20)))
                           for i in range(1, 60)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = list(dc.blocks(bench, 5, 200))
    assert sorted(len(b.ids) for b in found)[-1] <= 10 and sum(len(b.ids) for b in found) == 60
    assert [b.ids for b in found if len(b.tokens[0]) == 5000] == [[0]]
    rows = [(1, long[: len(long) * 3 // 4]), (2, items[7][1]), (3, "clean text")]
    got = {(r["doc_id"], r["item_id"]) for r in dc.leaks(docs(spark, rows), bench,
                                                         block_words=400).collect()}
    assert got == {(1, 0), (2, 7)}


def test_tiles_never_overlap():
    rng = np.random.default_rng(0)
    for _ in range(60):
        item, text = (rng.integers(0, 4, n).astype(np.uint64) for n in (30, 80))
        tiles = dc.tile(item, text, 3)
        for side in (0, 1):
            used = [k for t in tiles for k in range(t[side], t[side] + t[2])]
            assert len(used) == len(set(used))
        assert sum(t[2] for t in tiles) == greedy(item.tolist(), text.tolist(), 3)


def test_query_against_brute_force(spark, sf):
    read = lambda name, key: [(r[key], r["text"]) for r in spark.read.parquet(
        f"{sf}/{name}.parquet").collect()]
    rows, items = read("documents", "doc_id"), read("benchmark", "item_id")
    same(QUERIES["op1_string_tiling"](spark, sf).collect(), rows, items)
