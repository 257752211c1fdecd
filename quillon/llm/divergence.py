"""How far the sources of a language diverge in their use of terms.

One pass counts terms per (language, source) inside the tasks. A term kept for its language (it
stands in at least ``least_docs`` of its documents) gets an id in a block of about ``block_terms``
terms, and every group's counts become sorted (term id, count) arrays, one a block, packed as
variable-length bytes. Then a task per unordered pair of groups and block co-groups the two arrays:
a galloping intersection finds the terms both use, and overlaps, one-sided terms and terms that
neither uses are priced in both directions. Only sums of blocks leave the tasks.

The price of a term: with p = 1 + floor(10^9 (count + 1) / (N + V)) of the one group, N its counts
of kept terms and V their number, and q the same of the other, floor((p - q)^2 / q). All arithmetic
is exact in 64 bits while N + V is below 9 * 10^13. ``audit`` also ranks every group's own kept
terms that it uses more than its language does.

Bounds: a pair task holds two arrays of a block; a block of b terms in s sources has at most b * s
counts to number, sorted by Spark. The arrays travel once for every partner, as the result has a row
for every ordered pair; small tables with a row per group are broadcast only when counted small.

Defined cases: null text, language or source counts as ''; terms are runs of a-z, A-Z (lower-cased)
and non-ASCII characters; each row is a document of its own, also if its id is null or repeated; a
group without terms takes part; a language without kept terms has pairs of value 0 and no terms; a
lone source has no pairs; equal values rank by item; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.runs import lowered, slices
from quillon.session import erase, written

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
GAP = re.compile(r"[\x00-\x40\x5B-\x60\x7B-\x7F]")
UNIT = 1_000_000_000
LEAST_DOCS, TOP_TERMS, BLOCK_TERMS = 3, 200, 32_768
HELD, SHARED_ROWS, RUN = 300_000, 100_000, 256
_COUNTED = "lang string, source string, term string, n long, docs long"


def term_counts(docs: DataFrame, most: int = HELD) -> DataFrame:
    """Partial counts: lang, source, term, occurrences, documents. Every group also has a row
    without a term. A task holds about ``most`` (group, term) counts at a time."""
    kinds = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()),
                       ("n", pa.int64()), ("docs", pa.int64())])

    def flushed(held: dict) -> pa.RecordBatch:
        rows = [(lang, source, term, n, seen[term]) for (lang, source), (times, seen) in held.items()
                for term, n in [*times.items(), (None, 0)]]
        return pa.RecordBatch.from_arrays(
            [pa.array(values, kind.type) for values, kind in zip(zip(*rows), kinds)], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = defaultdict(lambda: (Counter(), Counter())), 0
        for batch in batches:
            groups = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for group, text in zip(groups, lowered(batch.column(2))):
                times, seen = held[group]
                size -= len(times)
                own = set()
                for start, end in slices(text, GAP):
                    found = TERM.findall(text, start, end)
                    times.update(found)
                    own.update(found)
                seen.update(own)
                size += len(times)
                if size > most:
                    yield flushed(held)
                    held.clear()
                    size = 0
        if held:
            yield flushed(held)

    read = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    return docs.select(*read, "text").mapInArrow(run, _COUNTED)


def kept_terms(docs: DataFrame, least_docs: int) -> DataFrame:
    """lang, source, term, n, lang_n (the language's count), first (once per language and term) of
    kept terms, and a row without a term for every group. One shuffle by (lang, term)."""
    of_term = Window.partitionBy("lang", "term")
    counted = term_counts(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return (counted.withColumns({
        "lang_n": F.sum("n").over(of_term), "lang_docs": F.sum("docs").over(of_term),
        "first": F.row_number().over(of_term.orderBy("source")) == 1})
        .filter(F.col("term").isNull() | (F.col("lang_docs") >= least_docs))
        .drop("docs", "lang_docs"))


def group_totals(kept: DataFrame) -> DataFrame:
    """lang, source, total (N of the group), kinds (V of the language), lang_total (its N)."""
    is_term = F.col("term").isNotNull()
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count_if(is_term & F.col("first")).alias("kinds"),
                                     F.sum("n").alias("lang_total"))
    return groups.join(langs, "lang")


def share(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (total + kinds)), divided in two steps to stay in 64 bits."""
    high = (count + 1) * 100_000
    whole = F.lit(total + kinds)
    rest = F.call_function("mod", high, whole) * 10_000
    div = lambda a, b: F.floor(F.call_function("div", a, b)).cast("long")
    return F.lit(1).cast("long") + div(high, whole) * 10_000 + div(rest, whole)


def shares(counts: np.ndarray, total: int, kinds: int) -> np.ndarray:
    """``share`` of an array of counts."""
    high, rest = np.divmod((counts + 1) * 100_000, total + kinds)
    return 1 + high * 10_000 + rest * 10_000 // (total + kinds)


def pack(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted (id, count) pairs as bytes of seven bits: id steps and counts in turn."""
    values = np.empty(2 * len(ids), np.uint64)
    values[::2] = np.diff(ids, prepend=0)
    values[1::2] = counts
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >= np.uint64(1 << 7 * k)
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        more = size > k
        part = (values[more] >> np.uint64(7 * k)) & np.uint64(127)
        out[at[more] + k] = part + np.uint64(128) * (size[more] > k + 1)
    return out.tobytes()


def unpack(data: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """The (ids, counts) that ``pack`` took; none for None."""
    raw = np.frombuffer(data or b"", np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    values = np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), starts)
    return np.cumsum(values[::2]), values[1::2]


def gallop(few: np.ndarray, many: np.ndarray) -> np.ndarray:
    """For each of ``few`` the place of the first value of ``many`` that is not smaller. A run of
    values starts from the last place found and doubles its step until it is passed."""
    out, at = np.empty(len(few), np.int64), 0
    for i in range(0, len(few), RUN):
        part, step = few[i: i + RUN], RUN
        while at + step < len(many) and many[at + step] < part[-1]:
            step *= 2
        out[i: i + len(part)] = at + np.searchsorted(many[at: at + step + 1], part)
        at = int(out[i + len(part) - 1])
    return out


def both_ways(a: tuple, b: tuple, size: int) -> tuple[int, int]:
    """Summed prices of a block of ``size`` terms, of a against b and of b against a.

    Each side is (ids, counts, total, kinds).
    """
    if size == 0:
        return 0, 0
    (ids_a, n_a, *whole_a), (ids_b, n_b, *whole_b) = a, b
    p_a, p_b = shares(n_a, *whole_a), shares(n_b, *whole_b)
    none_a, none_b = shares(np.zeros(1, np.int64), *whole_a), shares(np.zeros(1, np.int64), *whole_b)
    few, many = (ids_a, ids_b) if len(ids_a) <= len(ids_b) else (ids_b, ids_a)
    place = gallop(few, many)
    inside = np.flatnonzero(place < len(many))
    met = inside[many[place[inside]] == few[inside]]
    in_a, in_b = (met, place[met]) if few is ids_a else (place[met], met)
    only_a, only_b = np.ones(len(ids_a), bool), np.ones(len(ids_b), bool)
    only_a[in_a] = only_b[in_b] = False
    absent = size - len(ids_a) - len(ids_b) + len(met)

    def price(p: np.ndarray, q: np.ndarray) -> int:
        return int(((p - q) * (p - q) // q).sum())

    ab = price(p_a[in_a], p_b[in_b]) + price(p_a[only_a], none_b) + price(none_a, p_b[only_b])
    ba = price(p_b[in_b], p_a[in_a]) + price(none_b, p_a[only_a]) + price(p_b[only_b], none_a)
    return ab + absent * price(none_a, none_b), ba + absent * price(none_b, none_a)


def _shared(table: DataFrame, rows: int) -> DataFrame:
    """Broadcast if its counted rows are few, else joined by shuffle."""
    return F.broadcast(table) if rows <= SHARED_ROWS else table


def _packed(cells: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ids, counts = (np.asarray(part) for part in lists.flatten().flatten())
            at = np.concatenate([[0], np.cumsum(lists.value_lengths())])
            made = [pack(ids[i:j], counts[i:j]) for i, j in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(made, pa.binary())],
                ["lang", "source", "block", "packed"])

    return cells.select("lang", "source", "block", "pairs").mapInArrow(
        run, "lang string, source string, block long, packed binary")


def term_arrays(kept: DataFrame, groups: DataFrame, rows: int, block_terms: int) -> DataFrame:
    """lang, source, block, size (terms of the block), packed: every group in every block."""
    kinds = groups.groupBy("lang").agg(F.first("kinds").alias("kinds"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("kinds") / block_terms))
    placed = kept.filter("term IS NOT NULL").join(_shared(kinds, rows), "lang").withColumn(
        "block", F.pmod(F.xxhash64("term"), blocks))
    numbered = placed.withColumn("id", F.dense_rank().over(
        Window.partitionBy("lang", "block").orderBy("term")).cast("long"))
    cells = numbered.groupBy("lang", "block", "source").agg(
        F.sort_array(F.collect_list(F.struct("id", "n"))).alias("pairs"),
        F.count_if("first").alias("firsts"))
    cells = written(cells, "divergence-cells")
    sizes = cells.groupBy("lang", "block").agg(F.sum("firsts").alias("size"))
    wanted = groups.select("lang", "source").join(_shared(sizes, rows), "lang", "left").select(
        "lang", "source", F.coalesce("block", F.lit(0)).cast("long").alias("block"),
        F.coalesce("size", F.lit(0)).alias("size"))
    arrays = written(wanted.join(_packed(cells), ["lang", "source", "block"], "left"),
                     "divergence-arrays")
    erase(cells)
    return arrays


def pair_values(arrays: DataFrame, groups: DataFrame, rows: int) -> DataFrame:
    """lang, source, item, value for every ordered pair of a language's sources."""
    one = groups.select("lang", F.col("source").alias("a"))
    pairs = one.join(one.withColumnRenamed("a", "b"), "lang").filter("a < b")
    full = arrays.join(_shared(groups, rows), ["lang", "source"])

    def side(name: str) -> DataFrame:
        columns = ["lang", "a", "b", "block", "size", "total", "kinds", "packed"]
        return full.withColumnRenamed("source", name).join(pairs, ["lang", name]).select(
            *[F.col(c).alias(c) for c in columns])

    def priced(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = ((*unpack(t["packed"][0].as_py()), t["total"][0].as_py(), t["kinds"][0].as_py())
                for t in (left, right))
        ab, ba = both_ways(a, b, left["size"][0].as_py())
        lang, first, second, _ = (k.as_py() for k in key)
        return pa.table({"lang": [lang, lang], "source": [first, second], "item": [second, first],
                         "value": pa.array([ab, ba], pa.int64())})

    keys = ["lang", "a", "b", "block"]
    return side("a").groupBy(*keys).cogroup(side("b").groupBy(*keys)).applyInArrow(
        priced, "lang string, source string, item string, value long").groupBy(
        "lang", "source", "item").agg(F.sum("value").alias("value"))


def telling_terms(kept: DataFrame, groups: DataFrame, rows: int) -> DataFrame:
    """lang, source, item, value of the terms a group uses more than its language does."""
    p, q = F.col("p"), F.col("q")
    return (kept.filter("n > 0").join(_shared(groups, rows), ["lang", "source"])
            .select("lang", "source", F.col("term").alias("item"),
                    share(F.col("n"), F.col("total"), F.col("kinds")).alias("p"),
                    share(F.col("lang_n"), F.col("lang_total"), F.col("kinds")).alias("q"))
            .filter(p > q).select("lang", "source", "item", F.call_function(
                "div", (p - q) * (p - q), q).cast("long").alias("value")))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS,
          block_terms: int = BLOCK_TERMS) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank.

    All pairs are returned; of the terms only ranks to ``top_terms``.
    """
    kept = written(kept_terms(docs, least_docs), "divergence-terms")
    groups = written(group_totals(kept), "divergence-groups")
    rows = groups.count()
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(
        F.desc("value"), "item"))
    arrays = term_arrays(kept, groups, rows, block_terms)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = pair_values(arrays, groups, rows).withColumns(
        {"part": F.lit("pair"), "rank": rank}).select(columns)
    terms = telling_terms(kept, groups, rows).withColumns(
        {"part": F.lit("term"), "rank": rank}).filter(F.col("rank") <= top_terms).select(columns)
    return pairs.unionByName(terms)
