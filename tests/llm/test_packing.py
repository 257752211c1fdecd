import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import awkward, docs
from tokenizers import Tokenizer

from quillon.llm import packing
from quillon.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, texts, capacity):
    """Pieces cut every text as the plain encoder does; sequences are gapless and within capacity."""
    encoder = Tokenizer.from_file(PATH)
    want = []
    for key, text in texts:
        ids = encoder.encode(text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            piece = ids[at: at + capacity]
            want.append((key, k, at, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())))
    order = lambda x: tuple(-1 if v is None else v for v in x)
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(got, key=order) == sorted(want, key=order)
    spans = {}
    for r in rows:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for members in spans.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    return len(spans), sum(r["length"] for r in rows)


def test_awkward_rows(spark):
    texts = awkward()
    df = packing.pack(docs(spark, texts, uid=7, fill="x", bin=None), PATH)
    assert df.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id",
                          "offset"]
    check(df.collect(), texts, 2048)


def test_empty_table(spark):
    assert packing.pack(docs(spark, []), PATH).count() == 0


def test_query_is_tight(spark, sf):
    rows = QUERIES["op8_best_fit_packing"](spark, sf).collect()
    texts = [(r["doc_id"], r["text"])
             for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    sequences, tokens = check(rows, texts, 2048)
    assert sequences <= -(-tokens // 2048) * 1.02 + 1


@pytest.mark.parametrize("sizes", [[1100] * 500, [1] * 3000, [700, 1400] * 400, [1024] * 7])
def test_rounds_end_and_lose_nothing(spark, sizes):
    frame = spark.createDataFrame(list(enumerate(sizes)), "uid long, length long")
    rows = packing.assign(frame, per_group=40).collect()
    assert sorted(r["uid"] for r in rows) == list(range(len(sizes)))
    used = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], sizes[r["uid"]]))
    for members in used.values():
        at = 0
        for offset, size in sorted(members):
            assert offset == at
            at += size
        assert at <= 2048


def test_kept_ids(spark):
    row = packing.pack(docs(spark, [(1, "the the")]), PATH, keep_ids=True).first()
    assert zlib.crc32(row["ids"]) == row["ids_crc32"] and len(row["ids"]) == 4 * row["length"]
