"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct n-grams (3 to 5 code points of the lower-cased text with a space
before and after, hashed to 2^18 places). Each place's smoothed log-count ratio between toxic and
clean texts scales it; places seen in too few texts or with too weak a ratio are left out; a ridge
logistic regression on the scaled features gives the score.

The fit uses at most ``rows`` labelled documents. Scoring reads whole texts. Defined cases: null is
scored as the empty text, and an empty text has the score of a text without features; rows are
scored one by one, so repeated rows repeat; without labels of both kinds the score is the smoothed
share of toxic labels; an empty table gives no rows.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import labelled
from quillon.llm.words import lists
from quillon.session import erase, written

ORDERS = (3, 4, 5)
BITS = 18
FIT_ROWS = 12_000
FEATURES = 1 << 14
_K, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_SLICE = 1 << 19


@dataclasses.dataclass
class Model:
    """``slot``: feature number of each hash place or -1; ``weight``: per feature; ``bias``."""

    slot: np.ndarray
    weight: np.ndarray
    bias: float


def _slices(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    i = 0
    while i < len(texts):
        part, size, first = [], 0, i
        while i < len(texts) and (not part or size < _SLICE):
            part.append(f" {(texts[i] or '').lower()} ")
            size += len(part[-1])
            i += 1
        yield first, part


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: number of the text and hash place of every n-gram."""
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    code = code.astype(np.uint64) + np.uint64(1)
    h = code
    for n in range(2, max(ORDERS) + 1):
        h = h[: len(code) - n + 1] * _K + code[n - 1:]
        if n in ORDERS:
            own = owner[: len(h)]
            keep = own == owner[n - 1:]
            place = ((h ^ (h >> np.uint64(29))) * _SPREAD) >> np.uint64(64 - BITS)
            yield own[keep], place[keep].astype(np.int64)


def _counts(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with each place, and texts, by label: summed in the tasks, one row from each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_place, texts = np.zeros((2, 1 << BITS), np.int32), np.zeros(2, np.int64)
        seen = np.zeros(1 << BITS, bool)
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                               strict=True):
                seen[:] = False
                for _, place in grams([f" {(text or '').lower()} "]):
                    seen[place] = True
                with_place[y] += seen
                texts[y] += 1
        yield pa.RecordBatch.from_pydict(
            {"counts": [with_place.tobytes()], "texts": [texts.tobytes()]},
            pa.schema([("counts", pa.binary()), ("texts", pa.binary())]))

    total, texts = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
    for row in sample.select("text", "y").mapInArrow(count, "counts binary, texts binary").collect():
        total += np.frombuffer(row["counts"], np.int32).reshape(2, -1)
        texts += np.frombuffer(row["texts"], np.int64)
    return total[1], total[0], texts


def _present(slot: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs of the chosen features."""
    pairs = [np.zeros(0, np.int64)]
    width = int(slot.max(initial=0)) + 1
    for own, place in grams(texts):
        feature = slot[place]
        hit = feature >= 0
        pairs.append(own[hit] * width + feature[hit])
    pairs = np.unique(np.concatenate(pairs))
    return pairs // width, pairs % width


def _features(sample: DataFrame, slot: np.ndarray) -> DataFrame:
    """(y, present): the numbers of each sampled text's chosen features, as words."""
    shared = sample.sparkSession.sparkContext.broadcast(slot)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.arange(slot_count).astype(str).astype(object)
        for batch in batches:
            labels = batch.column(1).to_pylist()
            for first, part in _slices(batch.column(0).to_pylist()):
                own, feature = _present(shared.value, part)
                counts = np.bincount(own, minlength=len(part))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(labels[first: first + len(part)], pa.int32()),
                     lists(names[feature], counts, pa.string())], ["y", "present"])

    slot_count = int(slot.max()) + 1
    return sample.select("text", "y").mapInArrow(extract, "y int, present array<string>")


def _regress(rows: DataFrame, scale: np.ndarray, texts: np.ndarray, ridge: float,
             steps: int = 100) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on 0/1 features times ``scale``; weights for unscaled features.

    Texts of the rarer label weigh more, by the root of how much rarer it is.
    """
    rarer, often = int(texts.argmin()), texts.max() / texts.min()
    weighted = rows.withColumn("weight", F.when(F.col("y") == rarer, float(often**0.5))
                               .otherwise(1.0))
    counted = CountVectorizerModel.from_vocabulary(
        [str(i) for i in range(len(scale))], "present", "binary").setBinary(True)
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(scale), inputCol="binary",
                                outputCol="features")
    model = LogisticRegression(labelCol="y", weightCol="weight", regParam=ridge, maxIter=steps,
                               standardization=False, tol=1e-8).fit(
        scaled.transform(counted.transform(weighted)))
    return model.coefficients.toArray() * scale, float(model.intercept)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS,
        features: int = FEATURES, alpha: float = 1.0, least: int = 3,
        ridge: float = 1e-3) -> Model:
    """Learn from at most ``rows`` labelled documents; the model has at most ``features`` weights."""
    sample = written(labelled.sample(docs, labels, label, rows).coalesce(16), "toxicity-sample")
    bad, good, texts = _counts(sample)
    if texts.min() == 0:
        share = (texts[1] + 1) / (texts.sum() + 2)
        erase(sample)
        return Model(np.full(1 << BITS, -1), np.zeros(1), float(np.log(share / (1 - share))))
    ratio = (np.log((bad + alpha) / (texts[1] + 2 * alpha))
             - np.log((good + alpha) / (texts[0] + 2 * alpha)))
    enough = bad + good >= least
    spread = np.sqrt(1 / (bad + alpha) + 1 / (good + alpha))
    strength = np.where(enough, np.abs(ratio) / spread, 0.0)
    chosen = np.argsort(-strength, kind="stable")[:features]
    chosen = np.sort(chosen[strength[chosen] > 1.0])
    slot = np.full(1 << BITS, -1)
    slot[chosen] = np.arange(len(chosen))
    if not len(chosen):
        share = (texts[1] + 1) / (texts.sum() + 2)
        erase(sample)
        return Model(slot, np.zeros(1), float(np.log(share / (1 - share))))
    weight, bias = _regress(_features(sample, slot), ratio[chosen], texts, ridge)
    erase(sample)
    return Model(slot, weight, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            total = np.empty(batch.num_rows)
            for first, part in _slices(batch.column(1).to_pylist()):
                own, feature = _present(m.slot, part)
                total[first: first + len(part)] = np.bincount(
                    own, m.weight[feature], len(part)) + m.bias
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(total, -40, 40))))],
                ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, score double")
