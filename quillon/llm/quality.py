"""Quality: attention-based multiple-instance learning over passages.

A text is a bag of passages of ``SPAN`` words. Every passage is described by shares of byte classes
(each ASCII mark by itself, digits, capitals, lower case, other bytes, line ends), word lengths and
repetition inside the passage and against the text before it, and is encoded by one learned layer.
Gated attention (a tanh branch times a sigmoid branch) weights the encodings; the score is a
logistic function of the weighted sum. All weights are learned together from document labels only.

The fit uses at most ``rows`` labelled documents, every passage of each; documents are taken in order
of a hash of their id while all their passages fit into ``budget``, so a document is used whole or not
at all. Scoring encodes every passage of whole texts. Defined cases: a null or blank text is a bag with one passage
of zeros; rows are scored one by one, so repeated rows repeat; without labels of both kinds the
score is the smoothed share of label 1; an empty table gives no rows.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm import labelled, words
from quillon.session import erase, written

SPAN = 64
FIT_ROWS = 6_000
FIT_PASSAGES = 250_000
_CLASS = np.zeros(256, np.int64)
_MARKS = [b for b in range(33, 127) if not chr(b).isalnum()]
_CLASS[_MARKS] = np.arange(5, 5 + len(_MARKS))
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 1, 2, 3, 4
_NEWLINE = 5 + len(_MARKS)
_CLASS[10] = _NEWLINE
_CLASSES = _NEWLINE + 1
WIDTH = _CLASSES + 6


def passages(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number of the first text of a slice, passages per text, and the passages' features."""
    for first, data, starts, ends, at, hashed in words.texts(column, lower=False):
        n_words = np.diff(at)
        per_text = np.maximum(1, -(-n_words // SPAN))
        total = int(per_text.sum())
        x = np.zeros((total, WIDTH))
        if len(starts):
            head = np.cumsum(per_text) - per_text
            owner = np.repeat(np.arange(len(n_words)), n_words)
            passage = head[owner] + (np.arange(len(starts)) - at[owner]) // SPAN
            n = np.bincount(passage, minlength=total).astype(float)
            some = np.maximum(n, 1)
            # bytes from a word's start to the next word's start belong to its passage; after a
            # text's last word only the text's end is left, which does not count
            until = np.append(starts[1:], ends[-1])
            last = at[1:][n_words > 0] - 1
            until[last] = ends[last]
            reach = until - starts
            byte = np.repeat(passage, reach)
            place = np.arange(len(byte)) - np.repeat(np.cumsum(reach) - reach, reach)
            kind = _CLASS[data[np.repeat(starts, reach) + place]]
            counts = np.bincount(byte * _CLASSES + kind, minlength=total * _CLASSES)
            counts = counts.reshape(total, _CLASSES).astype(float)
            x[:, :_CLASSES] = counts / np.maximum(counts.sum(1, keepdims=True), 1)
            size = (ends - starts).astype(float)
            mean = np.bincount(passage, size, total) / some
            x[:, _CLASSES] = mean / 8
            x[:, _CLASSES + 1] = np.sqrt(np.maximum(
                np.bincount(passage, size**2, total) / some - mean**2, 0)) / 8
            x[:, _CLASSES + 2] = np.bincount(_distinct(passage, hashed), minlength=total) / some
            same = np.zeros(len(starts), bool)
            same[1:] = (hashed[1:] == hashed[:-1]) & (passage[1:] == passage[:-1])
            x[:, _CLASSES + 3] = np.bincount(passage, same, total) / some
            triple = words.mix(hashed)
            triple[:-2] += words.mix(hashed[1:-1] * np.uint64(3)) + hashed[2:] * np.uint64(7)
            key = triple + words.mix(owner.astype(np.uint64))
            seen = np.ones(len(key), bool)
            seen[np.unique(key, return_index=True)[1]] = False
            x[:, _CLASSES + 4] = np.bincount(passage, seen, total) / some
            x[:, _CLASSES + 5] = np.minimum(n / SPAN, 1)
        yield first, per_text, x


def _distinct(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The group of every distinct (group, value) pair."""
    key = value + words.mix(group.astype(np.uint64) + np.uint64(1))
    return group[np.unique(key, return_index=True)[1]]


@dataclasses.dataclass
class Model:
    """Standardisation and the weights of encoder, gated attention and classifier."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def score(self, x: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        return _forward(self.weights, x, per_text)[0]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _forward(w, x, per_text):
    start = np.cumsum(per_text) - per_text
    h = np.tanh(x @ w["E"] + w["e"])
    t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    logit = (t * g) @ w["a"]
    grown = np.exp(logit - np.repeat(np.maximum.reduceat(logit, start), per_text))
    attention = grown / np.repeat(np.add.reduceat(grown, start), per_text)
    z = np.add.reduceat(attention[:, None] * h, start)
    return _sigmoid(z @ w["c"] + w["b"][0]), (h, t, g, attention, z, start)


def _gradient(w, x, per_text, y):
    p, (h, t, g, attention, z, start) = _forward(w, x, per_text)
    d = (p - y) / len(y)
    grad = {"c": z.T @ d, "b": np.array([d.sum()])}
    dz = np.repeat(d[:, None] * w["c"], per_text, axis=0)
    da = (dz * h).sum(1)
    dl = attention * (da - np.repeat(np.add.reduceat(attention * da, start), per_text))
    grad["a"] = (t * g).T @ dl
    dt = dl[:, None] * w["a"] * g * (1 - t**2)
    dg = dl[:, None] * w["a"] * t * g * (1 - g)
    grad["V"], grad["U"] = h.T @ dt, h.T @ dg
    dh = (dz * attention[:, None] + dt @ w["V"].T + dg @ w["U"].T) * (1 - h**2)
    grad["E"], grad["e"] = x.T @ dh, dh.sum(0)
    return grad


def _learn(x, per_text, y, hidden=24, gate=12, epochs=40, batch=128, rate=5e-3, decay=1e-4, seed=7):
    """Adam on the mean cross-entropy of whole bags."""
    rng = np.random.default_rng(seed)
    draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    w = {"E": draw(x.shape[1], hidden), "e": np.zeros(hidden), "V": draw(hidden, gate),
         "U": draw(hidden, gate), "a": draw(gate), "c": draw(hidden), "b": np.zeros(1)}
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    start, step = np.cumsum(per_text) - per_text, 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            bags = order[i: i + batch]
            sizes = per_text[bags]
            rows = np.repeat(start[bags] - (np.cumsum(sizes) - sizes), sizes) + np.arange(
                sizes.sum())
            step += 1
            pace = rate * (1 - epoch / epochs) + 1e-5
            for k, g in _gradient(w, x[rows], sizes, y[bags]).items():
                g = g + decay * w[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] -= pace * (first[k] / (1 - 0.9**step)) / (
                    np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return w


def bags(docs: DataFrame, labels: DataFrame, label: str, rows: int, budget: int) -> DataFrame:
    """(doc_id, y, n, x) of the documents to fit on: all ``n`` passages' features of each."""
    sample = written(labelled.sample(docs, labels, label, rows).coalesce(16), "quality-sample")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, per_text, x in passages(batch.column(1)):
                ends = np.cumsum(per_text)
                found = [x[end - n: end] for n, end in zip(per_text, ends, strict=True)]
                mine = slice(first, first + len(found))
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": batch.column(0)[mine], "y": batch.column(2)[mine],
                     "n": per_text.astype(np.int64),
                     "x": [f.astype("<f4").tobytes() for f in found]},
                    pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("n", pa.int64()),
                               ("x", pa.binary())]))

    described = written(sample.select("doc_id", "text", "y").mapInArrow(
        describe, "doc_id long, y int, n long, x binary"), "quality-bags")
    erase(sample)
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id")
    fits = described.select("doc_id", "n").filter(F.col("n") <= budget).withColumn(
        "upto", F.sum("n").over(order)).filter(F.col("upto") <= budget)  # at most ``rows`` rows
    return described.join(F.broadcast(fits.select("doc_id")), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS,
        budget: int = FIT_PASSAGES) -> Model:
    """Learn from at most ``rows`` labelled documents with at most ``budget`` passages in all."""
    got = sorted(bags(docs, labels, label, rows, budget).collect(), key=lambda r: r["doc_id"])
    y = np.array([r["y"] for r in got], float)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        zero = {"E": np.zeros((WIDTH, 1)), "e": np.zeros(1), "V": np.zeros((1, 1)),
                "U": np.zeros((1, 1)), "a": np.zeros(1), "c": np.zeros(1),
                "b": np.array([np.log(share / (1 - share))])}
        return Model(np.zeros(WIDTH), np.ones(WIDTH), zero)
    per_text = np.array([r["n"] for r in got])
    x = np.concatenate([np.frombuffer(r["x"], "<f4").reshape(-1, WIDTH) for r in got]).astype(float)
    del got
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    return Model(mean, scale, _learn(np.clip((x - mean) / scale, -8, 8), per_text, y))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty(batch.num_rows)
            for first, per_text, x in passages(batch.column(1)):
                out[first: first + len(per_text)] = model.score(x, per_text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)],
                                             ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, score double")


def keep(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, all columns as they came."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty(batch.num_rows)
            for first, per_text, x in passages(batch.column(at)):
                out[first: first + len(per_text)] = model.score(x, per_text)
            yield batch.filter(pa.array(out >= threshold))

    return docs.mapInArrow(run, docs.schema)
