"""Spelling variants grouped by Bloom-guided neighbourhoods.

1. Words are counted inside the tasks and summed: the vocabulary.
2. A blocked Bloom filter per word length (shard) is built from the vocabulary by Spark and
   broadcast. Every word generates its edits: each deletion of one letter, and each replacement by a
   letter that sorts after the replaced one. Of two near words exactly one generates the other, so
   every pair is met once. Edits are hashed and probed as NumPy arrays without being spelled out;
   only positives become text.
3. Positives are shuffled to an exact join with the vocabulary, which removes the false ones.
4. Every word's near words give its form; roots follow forms by doubling jumps over written tables.

Bounds: a broadcast holds the filters of at most ``slice_words`` words (two bytes a word); larger
vocabularies are probed in several passes, each with the filters of one hash slice, so no pass
misses a word. The letters are those of the word pattern, at most 90. Edits of a batch are made in
parts of about half a million, also those of a very long word. A word has at most about 2 * 90 near
words per letter. Forms grow tenfold each step, so a root is at most 19 steps away.

Defined cases: null text has no words; words are altered by a checksum of id and word (a null id
counts as ''), alike for all occurrences in a row; repeated rows count again; ties between forms go
to the smaller word; a word without near words has ``n_near`` 0, itself as root and no form; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.runs import lowered, slices
from quillon.llm.words import mix
from quillon.session import erase, written

LETTERS = [*range(97, 123), *range(0xC0, 0x100)]
GAP = re.compile(r"[^a-zÀ-ÿ]")
LEAST_LENGTH, LEAST_COUNT, MODULUS, TIMES = 7, 2, 31, 10
HELD, PART, SLICE_WORDS = 500_000, 1 << 19, 1 << 24
#: A block is four 64-bit lanes for 16 words on average; a word sets two bits in each lane.
WORDS_PER_BLOCK, LANES, LONGEST = 16, 4, 64
_BASE = 0x2545F4914F6CDD1D
_BACK = pow(_BASE, -1, 2**64)
_SALT = np.uint64(0x9E3779B97F4A7C15)


def altered(word: str, key: int, modulus: int = MODULUS) -> str:
    """The word less one letter if ``modulus`` divides the checksum that goes on from ``key``."""
    h = zlib.crc32(word.encode(), key)
    if h % modulus:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
               most: int = HELD) -> DataFrame:
    """(word, n) of all words long and frequent enough. A task holds ``most`` counts at a time."""
    runs = re.compile(rf"[a-zÀ-ÿ]{{{least_length},}}")

    def flushed(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()),
                                           pa.array(held.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), lowered(batch.column(1))):
                key = zlib.crc32(f"{'' if key is None else key}:".encode())
                for start, end in slices(text, GAP):
                    for word, n in Counter(runs.findall(text, start, end)).items():
                        held[altered(word, key)] += n
                if len(held) > most:
                    yield flushed(held)
                    held.clear()
        if held:
            yield flushed(held)

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .filter((F.col("n") >= least_count) & (F.length("word") >= least_length)))


def code_points(batch: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per length: places in the batch, and code points as a row per word."""
    at = np.array([len(w) for w in batch], np.int64)
    out = {}
    for size in np.unique(at):
        where = np.flatnonzero(at == size)
        data = "".join(batch[i] for i in where).encode("utf-32-le")
        out[int(size)] = (where, np.frombuffer(data, "<u4").reshape(len(where), size))
    return out


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


def polynomial(points: np.ndarray) -> np.ndarray:
    """The sum of code points times powers of the base, a number per row."""
    return (points.astype(np.uint64) * _powers(_BASE, points.shape[1])).sum(1, dtype=np.uint64)


class Filters:
    """Blocked Bloom filters, one per word length, as one array of blocks."""

    def __init__(self, first: dict[int, int], blocks: dict[int, int], lanes: np.ndarray):
        self.first, self.blocks, self.lanes = first, blocks, lanes

    def holds(self, length: int, sums: np.ndarray) -> np.ndarray:
        """Places of the sums whose word may be in the filter of this length."""
        left = np.arange(len(sums))
        size = self.blocks.get(shard(length), 0)
        if not size:
            return left[:0]
        hashed = mix(sums)
        block = self.first[shard(length)] + block_of(hashed, size)
        for lane in range(LANES):
            bits = lane_bits(hashed, lane)
            passed = np.flatnonzero((self.lanes[block, lane] & bits) == bits)
            left, block, hashed = left[passed], block[passed], hashed[passed]
        return left


def shard(length):
    """The filter of a length; the longest lengths share one."""
    return np.minimum(length, LONGEST) if isinstance(length, np.ndarray) else min(length, LONGEST)


def block_of(hashed: np.ndarray, blocks: int) -> np.ndarray:
    return ((hashed >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def lane_bits(hashed: np.ndarray, lane: int) -> np.ndarray:
    """Two bits of a lane, from a second mix of the hash."""
    spread = mix(hashed ^ _SALT) >> np.uint64(12 * lane)
    one, two = spread & np.uint64(63), (spread >> np.uint64(6)) & np.uint64(63)
    return (np.uint64(1) << one) | (np.uint64(1) << two)


def build(words: DataFrame) -> Filters:
    """The filters of a bounded set of words; the blocks are put together by Spark."""
    lengths = words.groupBy(F.least(F.length("word"), F.lit(LONGEST)).alias("s")).count().collect()
    blocks = {r["s"]: math.ceil(r["count"] / WORDS_PER_BLOCK) for r in sorted(lengths)}
    first = dict(zip(blocks, np.concatenate([[0], np.cumsum(list(blocks.values()))]).tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, (_, points) in code_points(batch.column(0).to_pylist()).items():
                hashed = mix(polynomial(points))
                at = first[shard(size)] + block_of(hashed, blocks[shard(size)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at), *(pa.array(lane_bits(hashed, i).view(np.int64))
                                     for i in range(LANES))],
                    ["block", *(f"l{i}" for i in range(LANES))])

    lanes = [f"l{i}" for i in range(LANES)]
    filled = words.select("word").mapInArrow(
        run, "block long, " + ", ".join(f"{lane} long" for lane in lanes)).groupBy("block").agg(
        *[F.bit_or(lane).alias(lane) for lane in lanes]).toArrow()
    out = np.zeros((sum(blocks.values()), LANES), np.uint64)
    at = np.asarray(filled["block"].combine_chunks(), np.int64)
    for i, lane in enumerate(lanes):
        out[at, i] = np.asarray(filled[lane].combine_chunks(), np.int64).view(np.uint64)
    return Filters(first, blocks, out)


def _spelled(points: np.ndarray) -> list[str]:
    size = points.shape[1]
    text = points.astype("<u4").tobytes().decode("utf-32-le")
    return [text[i: i + size] for i in range(0, len(text), size)] if size else [""] * len(points)


def deletions(points: np.ndarray, filters: Filters, keep) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Positive deletions: rows and spelled edits. Of a run of equal letters only the first goes."""
    m, size = points.shape
    power = _powers(_BASE, size)
    terms = points.astype(np.uint64) * power
    before = np.cumsum(terms, 1, dtype=np.uint64) - terms
    after = (terms.sum(1, dtype=np.uint64)[:, None] - before - terms) * np.uint64(_BACK)
    distinct = np.ones((m, size), bool)
    distinct[:, 1:] = points[:, 1:] != points[:, :-1]
    row, at = np.nonzero(distinct)
    sums = (before + after)[row, at]
    chosen = keep(sums)
    row, at, sums = row[chosen], at[chosen], sums[chosen]
    found = filters.holds(size - 1, sums)
    row, at = row[found], at[found]
    step = max(1, PART // max(1, size))
    for i in range(0, len(row), step):
        rest = points[row[i: i + step]]
        mask = np.ones(rest.shape, bool)
        mask[np.arange(len(rest)), at[i: i + step]] = False
        yield row[i: i + step], _spelled(rest[mask].reshape(len(rest), size - 1))


def replacements(points: np.ndarray, letters: np.ndarray, filters: Filters,
                 keep) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Positive replacements by later letters: rows and spelled edits, in parts of bounded size."""
    m, size = points.shape
    power, total = _powers(_BASE, size), polynomial(points)
    step = max(1, PART // max(1, m * len(letters)))
    for first in range(0, size, step):
        part = points[:, first: first + step]
        later = np.searchsorted(letters, part, "right")
        times = (len(letters) - later).ravel()
        cell = np.repeat(np.arange(part.size), times)
        place = np.arange(len(cell)) - np.repeat(np.cumsum(times) - times, times)
        letter = letters[np.repeat(later.ravel(), times) + place]
        row, at = cell // part.shape[1], cell % part.shape[1] + first
        sums = total[row] + (letter.astype(np.uint64) - points[row, at]) * power[at]
        chosen = keep(sums)
        row, at, letter, sums = row[chosen], at[chosen], letter[chosen], sums[chosen]
        found = filters.holds(size, sums)
        row, at, letter = row[found], at[found], letter[found]
        some = max(1, PART // max(1, size))
        for i in range(0, len(row), some):
            made = points[row[i: i + some]].copy()
            made[np.arange(len(made)), at[i: i + some]] = letter[i: i + some]
            yield row[i: i + some], _spelled(made)


def slice_of(sums: np.ndarray, slices_: int) -> np.ndarray:
    """The hash slice of a word, by bits that its block and lanes do not use alone."""
    return mix(mix(sums) + _SALT) % np.uint64(slices_)


def positives(words: DataFrame, letters: list[int], filters, number: int,
              slices_: int) -> DataFrame:
    """(word, n, edit) of all edits in slice ``number`` that the broadcast filters let pass."""
    letters = np.array(sorted(letters), np.uint32)

    def keep(sums: np.ndarray):
        return slice(None) if slices_ == 1 else np.flatnonzero(
            slice_of(sums, slices_) == np.uint64(number))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = filters.value
        for batch in batches:
            for size, (where, points) in code_points(batch.column(0).to_pylist()).items():
                step = max(1, PART // (size * max(1, len(letters))))
                for i in range(0, len(points), step):
                    some = points[i: i + step]
                    for row, edits in (*deletions(some, held, keep),
                                       *replacements(some, letters, held, keep)):
                        if edits:
                            at = pa.array(where[i + row])
                            yield pa.RecordBatch.from_arrays(
                                [batch.column(0).take(at), batch.column(1).take(at),
                                 pa.array(edits, pa.string())], ["word", "n", "edit"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, edit string")


def near_pairs(words: DataFrame, slice_words: int = SLICE_WORDS) -> DataFrame:
    """(word, n, near, near_n): every pair of near words once. ``words`` is read several times."""
    spark = words.sparkSession
    total = words.count()
    slices_ = max(1, math.ceil(total / slice_words))
    present = {ord(r["c"]) for r in words.select(
        F.explode(F.split("word", "")).alias("c")).filter("c <> ''").distinct().collect()}
    letters = [c for c in LETTERS if c in present]
    exact = words.select(F.col("word").alias("edit"), F.col("n").alias("near_n"))
    tasks = max(spark.sparkContext.defaultParallelism,
                int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = words.repartition(tasks, "word")
    found = []
    for number in range(slices_):
        own = words if slices_ == 1 else _of_slice(words, number, slices_)
        filters = spark.sparkContext.broadcast(build(own))
        passed = positives(dealt, letters, filters, number, slices_).join(exact, "edit").select(
            "word", "n", F.col("edit").alias("near"), "near_n")
        found.append(written(passed, "spelling-pairs"))
        filters.destroy()
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _of_slice(words: DataFrame, number: int, slices_: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = np.zeros(len(batch), bool)
            for where, points in code_points(batch.column(0).to_pylist()).values():
                mine[where] = slice_of(polynomial(points), slices_) == np.uint64(number)
            yield batch.filter(pa.array(mine))

    return words.select("word", "n").mapInArrow(run, "word string, n long")


def forms(words: DataFrame, pairs: DataFrame, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form, form_n of every word."""
    both = pairs.select(F.inline(F.array(
        F.struct("word", "near", "near_n"),
        F.struct(F.col("near").alias("word"), F.col("word").alias("near"),
                 F.col("n").alias("near_n")))))
    best = both.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    stands = (-F.col("best.less")) >= F.col("n") * times
    return words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(stands, F.col("best.near")).alias("form"),
        F.when(stands, -F.col("best.less")).alias("form_n"))


def roots(judged: DataFrame) -> DataFrame:
    """(word, root) of the words with a form: every round doubles the steps taken."""
    links = written(judged.filter("form IS NOT NULL").select("word", F.col("form").alias("root")),
                    "spelling-roots")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = written(links.join(ahead, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"),
            F.col("further").isNotNull().alias("moved")), "spelling-roots")
        erase(links)
        if after.filter("moved").isEmpty():
            return after.drop("moved")
        links = after.select("word", "root")
        links.written_to = after.written_to


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
             times: int = TIMES, slice_words: int = SLICE_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary."""
    words = written(vocabulary(docs, least_length, least_count), "spelling-words")
    judged = written(forms(words, near_pairs(words, slice_words), times), "spelling-forms")
    return judged.join(roots(judged), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
