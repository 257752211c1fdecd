import hashlib

import corpus_pipeline as cp
import pytest
from helpers import awkward, docs
from test_decontamination import brute as leaks_of
from test_near_duplicates import brute as groups_of
from test_packing import check
from test_repeats import brute as repeats_of

from quillon.llm import labelled, quality


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_every_stage_against_a_plain_version(spark, sf):
    docs_in = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter(
        labelled.remainder("doc_id", 4) != 2)
    model = quality.fit(docs_in, labels)
    good = {r["doc_id"] for r in quality.score(docs_in, model).collect() if r["score"] >= 0.7}
    now = cp.good_quality(spark, docs_in, sf).cache()
    assert {i for i, _ in rows_of(now)} == good and now.columns == docs_in.columns

    before, now = rows_of(now), cp.without_near_copies(spark, now, sf).cache()
    groups = groups_of(before, cp.SHINGLE_WORDS, cp.SIMILAR_PERCENT)
    assert sorted(rows_of(now)) == sorted(r for r in before if groups[r[0]][1] == r[0])

    before, now = rows_of(now), cp.without_repeats(spark, now, sf).cache()
    want = {i: (n - gone, sha) for i, n, gone, sha in repeats_of(before, 50)}
    for i, text in rows_of(now):
        words = (text or "").encode().split()
        assert (len(words), hashlib.sha256(b" ".join(words)).hexdigest()) == want[i]

    items = [(r["item_id"], r["text"])
             for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before, now = rows_of(now), cp.without_benchmark(spark, now, sf).cache()
    leaked = {i for i, _, _ in leaks_of(before, items)}
    assert sorted(rows_of(now)) == sorted(r for r in before if r[0] not in leaked)

    check(cp.packed(spark, now, sf).collect(), rows_of(now), 2048)
    spark.catalog.clearCache()


def test_run_equals_its_stages(spark, sf):
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, frame, sf)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        frame = out
    got = cp.run(spark, sf)
    key = ["doc_id", "piece", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(
        map(tuple, cp.packed(spark, frame, sf).select(*key).collect()))


@pytest.mark.parametrize("stage", [f for _, f in cp.STAGES])
def test_awkward_rows_and_none(spark, sf, stage):
    frame = docs(spark, awkward(2000), key="x", cid=1, id=5)
    out = stage(spark, frame, sf)
    if stage is not cp.packed:
        assert out.columns == frame.columns
    out.collect()
    assert stage(spark, docs(spark, []), sf).count() == 0


def test_repeated_rows_leave_one(spark, sf):
    text = " ".join(f"v{i}" for i in range(30))
    frame = docs(spark, [(1, text), (1, text), (2, text), (None, text), (None, text)])
    got = rows_of(cp.without_near_copies(spark, frame, sf))
    assert got == [(1, text)]


def test_a_near_copy_under_a_kept_id_goes(spark, sf):
    text = " ".join(f"v{i}" for i in range(60))
    other = " ".join(f"u{i}" for i in range(60))
    frame = docs(spark, [(3, text), (7, text + " more"), (7, other)])
    assert sorted(rows_of(cp.without_near_copies(spark, frame, sf))) == [(3, text), (7, other)]
