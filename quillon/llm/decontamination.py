"""Benchmark decontamination by greedy string tiling.

Texts are compared as words, lower-cased (A-Z) and without ASCII marks. A seed is ``least`` words in
a row. Every document's seeds are looked up in those of the benchmark; an item whose words are
covered by shared seeds to at least ``share`` is tiled against the document: the longest common
runs of words not yet marked are found by Karp-Rabin hashes of a search length that shrinks to
``least``, and marked on both sides, longest first. So reordered passages count, and no word counts
twice. An item is leaked if its tiles cover at least ``share`` of it.

The benchmark is cut into blocks of at most ``block_words`` words (counted, not guessed); each block
is broadcast and the documents are scanned once per block, so any number of items is served and
nothing is shuffled. An item longer than that is a block of its own.

Items with fewer than ``least`` words are seeds as a whole: they leak where all their words stand in
a row, as one tile.

Defined cases: null or blank texts share nothing; blank items are never leaked; repeated items count once, an item without an id keeps its null;
repeated documents are reported once each; empty tables give no leaks; extra columns are ignored
(``clean`` returns them).
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import words

LEAST, SHARE, BLOCK_WORDS = 5, 0.5, 1 << 20


@dataclasses.dataclass
class Block:
    """Items of a block: ids, words as hashes, and their seeds in order."""

    ids: list[int | None]
    tokens: list[np.ndarray]
    seeds: np.ndarray
    item: np.ndarray
    place: np.ndarray
    filter: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]


def _index(rows: list, least: int) -> Block:
    ids, tokens, seeds, item, place = [], [], [], [], []
    whole: dict[int, list[tuple[int, int]]] = {}
    column = pa.array([r["text"] for r in rows], pa.string())
    for first, _, _, _, at, hashed in words.texts(column, bare=True):
        for k in range(len(at) - 1):
            mine = hashed[at[k]: at[k + 1]]
            if len(mine) >= least:
                found = words.Runs(mine).of(np.arange(len(mine) - least + 1), least)
                seeds.append(found)
                item.append(np.full(len(found), len(ids)))
                place.append(np.arange(len(found)))
            elif len(mine):
                value = words.Runs(mine).of(np.zeros(1, np.int64), len(mine))[0]
                whole.setdefault(len(mine), []).append((int(value), len(ids)))
            if len(mine):
                ids.append(rows[first + k]["item_id"])
                tokens.append(mine)
    seeds = np.concatenate([np.zeros(0, np.uint64), *seeds])
    order = np.argsort(seeds, kind="stable")
    quick = np.zeros(1 << 22, bool)
    quick[(seeds >> np.uint64(42)).astype(np.int64)] = True
    flat = lambda x: np.concatenate([np.zeros(0, np.int64), *x])[order]
    short = {n: (np.array([v for v, _ in sorted(found)], np.uint64),
                 np.array([i for _, i in sorted(found)])) for n, found in whole.items()}
    return Block(ids, tokens, seeds[order], flat(item), flat(place), quick, short)


def blocks(benchmark: DataFrame, least: int, block_words: int) -> Iterator[Block]:
    """The benchmark in blocks of counted size; each is small enough to broadcast."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(
        "text is not null").distinct()
    size = F.size(F.split("text", r"\s+"))
    sized = items.withColumn("size", size)
    own = sized.filter(F.col("size") > block_words)
    for row in own.toLocalIterator():  # each alone is a block; one is held at a time
        yield _index([row], least)
    rest = sized.filter(F.col("size") <= block_words)
    total, n = rest.agg(F.sum("size")).first()[0] or 0, 1
    if total > block_words:
        n = math.ceil(2 * total / block_words)
        while (rest.groupBy(_block_of(n)).agg(F.sum("size").alias("s")).agg(F.max("s")).first()[0]
               > block_words) and n < total:
            n *= 2
    for k in range(n):
        rows = rest.filter(_block_of(n) == k).collect()
        if rows:
            yield _index(rows, least)


def _block_of(n: int) -> Column:
    return F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).alias("k")


def tile(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in text, place in item, words), longest first."""
    free_item, free_text = np.ones(len(item), bool), np.ones(len(text), bool)
    runs_item, runs_text = words.Runs(item), words.Runs(text)
    tiles, length = [], max(least, min(len(item), len(text)))
    while True:
        matches = _matches(item, text, free_item, free_text, runs_item, runs_text, length)
        blocked = False
        for size, i, t in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            if free_item[i: i + size].all() and free_text[t: t + size].all():
                free_item[i: i + size] = free_text[t: t + size] = False
                tiles.append((t, i, size))
            else:  # what is left of it may still be longer than the next
                blocked = True
                break
        if not blocked:
            if length == least:
                return tiles
            length = max(least, length // 2)


def _matches(item, text, free_item, free_text, runs_item, runs_text, length):
    """Maximal common runs of at least ``length`` free words: (words, item place, text place)."""
    def open_starts(free: np.ndarray) -> np.ndarray:
        if len(free) < length:
            return np.zeros(0, np.int64)
        taken = np.concatenate([[0], np.cumsum(~free)])
        return np.flatnonzero(taken[length:] == taken[: len(taken) - length])

    at_item, at_text = open_starts(free_item), open_starts(free_text)
    known: dict[int, list[int]] = {}
    for i, h in zip(at_item.tolist(), runs_item.of(at_item, length).tolist(), strict=True):
        known.setdefault(h, []).append(i)
    out = []
    for t, h in zip(at_text.tolist(), runs_text.of(at_text, length).tolist(), strict=True):
        for i in known.get(h, ()):
            if i and t and free_item[i - 1] and free_text[t - 1] and item[i - 1] == text[t - 1]:
                continue  # found from further left
            if not (item[i: i + length] == text[t: t + length]).all():
                continue
            size = length
            while (i + size < len(item) and t + size < len(text) and free_item[i + size]
                   and free_text[t + size] and item[i + size] == text[t + size]):
                size += 1
            out.append((size, i, t))
    return out


def _leaks(block: Block, hashed: np.ndarray, seeds: np.ndarray, least: int, share: float):
    """Leaked items of one document: (item number, tiles)."""
    quick = np.flatnonzero(block.filter[(seeds >> np.uint64(42)).astype(np.int64)])
    left = np.searchsorted(block.seeds, seeds[quick], "left")
    right = np.searchsorted(block.seeds, seeds[quick], "right")
    hit = right > left
    if not hit.any():
        return
    at, left, right = quick[hit], left[hit], right[hit]
    lefts, first = np.unique(left, return_index=True)
    found = np.concatenate([np.arange(a, b) for a, b in zip(lefts, right[first], strict=True)])
    for item in np.unique(block.item[found]).tolist():
        tokens = block.tokens[item]
        mine = found[block.item[found] == item]
        edge = np.zeros(len(tokens) + 1, np.int64)
        np.add.at(edge, block.place[mine], 1)
        np.add.at(edge, block.place[mine] + least, -1)
        if (np.cumsum(edge)[:-1] > 0).sum() < share * len(tokens):
            continue
        here = at[np.isin(seeds[at], block.seeds[mine])]
        near = np.zeros(len(hashed) + 1, np.int64)
        np.add.at(near, here, 1)
        np.add.at(near, here + least, -1)
        spot = np.flatnonzero(np.cumsum(near)[:-1] > 0)
        # words that no seed covers stand as one word of their own between the covered stretches
        gap = np.flatnonzero(np.diff(spot) > 1) + 1
        text = np.insert(hashed[spot], gap, np.uint64(0))
        origin = np.insert(spot, gap, -1)
        tiles = [(int(origin[t]), i, size) for t, i, size in tile(tokens, text, least)]
        if sum(size for _, _, size in tiles) >= share * len(tokens):
            yield item, tiles


def _short_leaks(block: Block, hashed: np.ndarray, at: np.ndarray) -> dict[int, list]:
    """Row of a slice -> its leaked short items, each as one tile at its first place."""
    out: dict[int, list] = {}
    for n, (values, items) in block.short.items():
        runs = words.Runs(hashed).of(np.arange(max(0, len(hashed) - n + 1)), n)
        left = np.searchsorted(values, runs, "left")
        hits = np.flatnonzero((left < len(values)) & (
            values[np.minimum(left, len(values) - 1)] == runs))
        row = np.searchsorted(at, hits, "right") - 1
        inside = hits + n <= at[row + 1]
        seen = set()
        for k, place, value in zip(row[inside], hits[inside], left[hits[inside]], strict=True):
            right = int(np.searchsorted(values, values[value], "right"))
            for item in items[value:right].tolist():
                if (k, item) not in seen and (block.tokens[item] == hashed[place: place + n]).all():
                    seen.add((k, item))
                    out.setdefault(int(k), []).append((item, [(int(place - at[k]), 0, n)]))
    return out


def _scan(column: pa.Array, block: Block, least: int, share: float):
    """(row, leaks of the row) for every text of a batch that has any."""
    for first, _, starts, _, at, hashed in words.texts(column, bare=True):
        short = _short_leaks(block, hashed, at)
        seeds = words.Runs(hashed).of(np.arange(max(0, len(starts) - least + 1)), least)
        some = block.filter[(seeds >> np.uint64(42)).astype(np.int64)]
        reach = np.concatenate([[0], np.cumsum(some)])
        for k in range(len(at) - 1):
            a, b = at[k], max(at[k], at[k + 1] - least + 1)
            found = short.get(k, [])
            if b > a and reach[b] > reach[a]:
                found = found + list(_leaks(block, hashed[a: at[k + 1]], seeds[a:b], least, share))
            if found:
                yield first + k, found


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, share: float = SHARE,
          block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document and leaked item: words of the item, words covered, and the tiles as
    places in the document, places in the item and lengths, in words."""
    kinds = [("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_words", pa.int64()),
             ("covered_words", pa.int64()), ("coverage", pa.float64()),
             *[(f"tile_{k}", pa.list_(pa.int64())) for k in ("doc", "item", "words")]]
    schema = ("doc_id long, item_id long, item_words long, covered_words long, coverage double, "
              "tile_doc array<long>, tile_item array<long>, tile_words array<long>")
    spark, out = docs.sparkSession, None

    def scanner(shared) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                rows = []
                for row, found in _scan(batch.column(1), block, least, share):
                    for item, tiles in found:
                        covered, total = sum(t[2] for t in tiles), len(block.tokens[item])
                        rows.append((batch.column(0)[row].as_py(), block.ids[item], total, covered,
                                     covered / total, *map(list, zip(*sorted(tiles), strict=True))))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, kind) for c, (_, kind) in
                         zip(zip(*rows, strict=True), kinds, strict=True)], [k for k, _ in kinds])

        return run

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for block in blocks(benchmark, least, block_words):
        part = texts.mapInArrow(scanner(spark.sparkContext.broadcast(block)), schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, share: float = SHARE,
          block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` without a leaked item, all columns as they came."""
    at = docs.columns.index("text")
    schema = docs.schema

    def keeper(shared) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                for row, found in _scan(batch.column(at), shared.value, least, share):
                    good[row] = not found
                yield batch.filter(pa.array(good))

        return run

    for block in blocks(benchmark, least, block_words):
        docs = docs.mapInArrow(keeper(docs.sparkSession.sparkContext.broadcast(block)), schema)
    return docs
