"""Near-duplicate documents by b-bit MinHash.

Every text's distinct word shingles give 256 minima. Runs of five minima are band keys; of each
minimum only the low four bits are kept, packed into sixteen longs. Texts with equal shingle sets
are one class, and only classes go on:

1. Classes that share a band key are a bucket. Each bucket has a centre: the member that meets most
   others over all bands. Every member is paired with its centres only, so a bucket of m members
   makes m pairs. The bit counts of two signatures, corrected for chance collisions of low bits,
   estimate the similarity; pairs far below the threshold go, the rest are confirmed on full sets.
2. Buckets of three and more whose members are still in different components are compared as
   blocks of bounded size inside tasks, first on signatures, then on full sets. A block returns
   only links that join components; blocks inside one component are skipped.
3. Components of all confirmed links; the document with the smallest id of each is kept.

Chance of a missed link at similarity 0.85: about 1e-12 by the bands (5e-9 at 0.8), under 1e-7 by
the estimate's margin of 5.5 standard deviations.

Defined cases: words are split at space and 09-0D after lower-casing A-Z; a text with fewer words
than a shingle is one shingle, one without words (or null) has none and links with nothing. A null
id links with nothing and is kept. Rows with the same id are judged each by its own text; ``one_of_each``
decides by row, with null ids last. Extra columns are ignored (``one_of_each`` returns them).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import words
from quillon.llm.graphs import components
from quillon.session import erase, written

MINIMA, BITS, BANDS, ROWS = 256, 4, 48, 5
PURE, CHUNK = 512, 1024
CHUNK_SHINGLES = 1 << 21
_RNG = np.random.default_rng(11)
_TIMES = (_RNG.integers(0, 2**32, MINIMA, np.uint32) | np.uint32(1))[:, None]
_PLUS = _RNG.integers(0, 2**32, MINIMA, np.uint32)[:, None]
_BAND = _RNG.integers(0, 2**64, (BANDS, ROWS + 1), np.uint64) | np.uint64(1)


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, _, starts, _, at, hashed in words.texts(column, lower=True):
        runs = words.Runs(hashed)
        n = np.diff(at)
        long = runs.of(np.arange(max(0, len(starts) - size + 1)), size)
        for i, count in enumerate(n):
            if count >= size:
                yield np.unique(long[at[i]: at[i] + count - size + 1])
            else:
                yield runs.of(at[i: i + 1], count) if count else np.zeros(0, np.uint64)


def minima(found: np.ndarray) -> np.ndarray:
    """The least value of each of 256 hash functions over a set."""
    short = (words.mix(found) >> np.uint64(32)).astype(np.uint32)
    least = np.full(MINIMA, 2**32 - 1, np.uint32)
    for i in range(0, len(short), 2048):
        np.minimum(least, (short[None, i: i + 2048] * _TIMES + _PLUS).min(1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    part = least[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    return words.mix((part * _BAND[:, :ROWS]).sum(1) + _BAND[:, ROWS])


def pack_bits(least: np.ndarray) -> np.ndarray:
    """The low four bits of every minimum, sixteen to a long."""
    low = (least & np.uint32(15)).astype(np.uint64).reshape(-1, 16)
    return (low << (np.arange(16, dtype=np.uint64) * np.uint64(BITS))).sum(1, dtype=np.uint64)


def digests(found: np.ndarray) -> tuple[int, int]:
    """Two independent sums over a set, equal for equal sets."""
    a, b = words.mix(found), words.mix(found ^ np.uint64(0x5851F42D4C957F2D))
    return int(a.sum().view(np.int64)), int(b.sum().view(np.int64))


def features(docs: DataFrame, size: int) -> DataFrame:
    """Per row: a hash of the text, set size, digests, packed low bits and band keys."""
    kinds = [("doc_id", pa.int64()), ("t", pa.int64()), ("n_shingles", pa.int64()),
             ("d1", pa.int64()), ("d2", pa.int64()), ("bits", pa.list_(pa.int64())),
             ("bands", pa.list_(pa.int64()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, d1, d2, bits, bands, count = [], [], [], [], [], []
            for found in shingle_sets(batch.column(1), size):
                n.append(len(found))
                one, two = digests(found)
                d1.append(one)
                d2.append(two)
                count.append(1 if len(found) else 0)
                if len(found):
                    least = minima(found)
                    bits.append(pack_bits(least))
                    bands.append(band_keys(least))
            none = [np.zeros(0, np.uint64)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()),
                 pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                 words.lists(words.signed(np.concatenate(none + bits)),
                             np.array(count, int) * (MINIMA // 16)),
                 words.lists(words.signed(np.concatenate(none + bands)),
                             np.array(count, int) * BANDS)], [k for k, _ in kinds])

    return _keyed(docs).mapInArrow(run, "doc_id long, t long, n_shingles long, d1 long, d2 long, "
                                        "bits array<long>, bands array<long>")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       F.xxhash64("text").alias("t"))


def _corrected(differing, total: int = MINIMA):
    """Similarity from the share of equal low bits, less what chance makes equal."""
    chance = 1 / 2**BITS
    return ((total - differing) / total - chance) / (1 - chance)


def estimate(a: Column, b: Column) -> Column:
    """Estimated similarity of two packed signatures by bit counts."""
    def differing(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseAND(F.lit(0x1111111111111111))
        return F.bit_count(d)

    off = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, x: s + x)
    return _corrected(off.cast("double"))


def cut_for(threshold: float, deviations: float = 5.5) -> float:
    chance = 1 / 2**BITS
    equal = threshold + (1 - threshold) * chance
    return threshold - deviations * math.sqrt(equal * (1 - equal) / MINIMA) / (1 - chance)


def _enough(common, total, percent: int):
    """100 * common >= percent * union, in whole numbers."""
    return 100 * common >= percent * (total - common)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x = np.frombuffer(x.as_buffer(), np.uint64)
                y = np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(_enough(common, len(both), percent))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    of = lambda side: sets.select(F.col("cid").alias(side), F.col("found").alias(f"set_{side}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select(
        "a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of equal leading key columns out of sorted batches; keys are longs."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        same = held and all(held[-1].column(k)[-1] == batch.column(k)[0] for k in range(keys))
        if held and not same:
            yield pa.Table.from_batches(held)
            held = []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            held.append(batch.slice(i, j - i))
            if j < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


_BLOCK = ["key", "low", "high"]


def _block_rows(buckets: DataFrame) -> DataFrame:
    """Members of buckets (key, band, cid, comp, n_shingles) once per block pair they take part in.

    The members of one component are cut into chunks of their own once there are many, so that
    chunk pairs within a component are never made; the others share chunks.
    """
    per_comp = buckets.groupBy("key", "comp").agg(
        F.count(F.lit(1)).alias("own"), F.sum("n_shingles").alias("own_size"))
    pure = F.col("own") >= PURE
    small = per_comp.groupBy("key").agg(
        *[F.sum(F.when(~pure, F.col(c)).otherwise(0)).alias(f"rest_{c}")
          for c in ("own", "own_size")])
    rows, size = (F.when(pure, F.col(c)).otherwise(F.col(f"rest_{c}")) for c in ("own", "own_size"))
    parts = F.ceil(F.greatest(rows / CHUNK, size / CHUNK_SHINGLES, F.lit(1.0)))
    chunk = F.xxhash64(F.when(pure, F.col("comp")).otherwise(-1), pure,
                       F.pmod(F.xxhash64("cid"), parts))
    sizes = per_comp.join(small, "key")
    members = buckets.join(sizes, ["key", "comp"]).select(
        "key", "band", "cid", "comp", chunk.alias("chunk"),
        F.when(pure, F.col("comp")).alias("all_of"))
    chunks = members.groupBy("key").agg(
        F.collect_set(F.struct("chunk", "all_of")).alias("chunks"))
    return (members.join(chunks, "key").withColumn("other", F.explode("chunks"))
            .filter("all_of is null or other.all_of is null or all_of <> other.all_of")
            .select("key", F.least("chunk", "other.chunk").alias("low"),
                    F.greatest("chunk", "other.chunk").alias("high"), "band", "cid", "comp"))


def _likely(rows: DataFrame, signatures: DataFrame, cut: float) -> DataFrame:
    """Block members with a likely partner in another component whose first shared band this is."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _runs(batches, 3):
            n = block.num_rows
            comp, band = block["comp"].to_numpy(), block["band"][0].as_py()
            flat = lambda c: block[c].combine_chunks().flatten().to_numpy().reshape(n, -1)
            packed, keys = flat("bits").view(np.uint64), flat("bands")
            nibbles = np.stack([(packed >> np.uint64(4 * k)) & np.uint64(15) for k in range(16)],
                               2).reshape(n, -1).astype(np.uint8)
            hit = np.zeros(n, bool)
            for i in range(n - 1):
                off = (nibbles[i + 1:] != nibbles[i]).sum(1)
                j = i + 1 + np.flatnonzero((_corrected(off) >= cut) & (comp[i + 1:] != comp[i]))
                if len(j):
                    j = j[(keys[j] == keys[i]).argmax(1) == band]
                    hit[j] = True
                    hit[i] |= len(j) > 0
            if hit.any():
                yield from block.select([*_BLOCK, "cid", "comp"]).filter(
                    pa.array(hit)).combine_chunks().to_batches()

    with_bits = rows.join(signatures, "cid").select(*_BLOCK, "band", "cid", "comp", "bits", "bands")
    return with_bits.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK).mapInArrow(
        run, "key long, low long, high long, cid long, comp long")


def _joining(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links on full sets between components, as few per block as join them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _runs(batches, 3):
            found = [np.frombuffer(x.as_buffer(), np.uint64) for x in
                     block["found"].combine_chunks()]
            size = np.array([len(f) for f in found])
            comp, cid = block["comp"].to_numpy(), block["cid"].to_numpy()
            shingle, inverse, times = np.unique(np.concatenate(found), return_inverse=True,
                                                return_counts=True)
            owner = np.repeat(np.arange(len(found)), size)
            shared = (times > 1)[inverse]
            column = (np.cumsum(times > 1) - 1)[inverse[shared]]
            common = np.zeros((len(found), len(found)), np.float32)
            for at in range(0, int(column.max(initial=-1)) + 1, 4096):
                part = (column >= at) & (column < at + 4096)
                dense = np.zeros((len(found), 4096), np.float32)
                dense[owner[shared][part], column[part] - at] = 1
                common += dense @ dense.T
            common = common.astype(np.int64)
            total = size[:, None] + size[None, :]
            linked = _enough(common, total, percent) & (comp[:, None] != comp[None, :])
            root = {int(c): int(c) for c in comp}

            def top(c: int, root=root) -> int:
                while root[c] != c:
                    c = root[c]
                return c

            a, b = [], []
            for i, j in zip(*np.nonzero(np.triu(linked)), strict=True):
                x, y = top(int(comp[i])), top(int(comp[j]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    a.append(cid[i])
                    b.append(cid[j])
            if a:
                yield pa.RecordBatch.from_pydict({"a": a, "b": b},
                                                 pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    with_sets = rows.join(sets.select("cid", "found"), "cid").select(*_BLOCK, "cid", "comp", "found")
    return with_sets.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK).mapInArrow(
        run, "a long, b long")


def _sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(cid, found): the sorted set of each wanted class, read from its first document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, right = [], []
            d1, d2 = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for k, s in enumerate(shingle_sets(batch.column(1), size)):
                right.append(digests(s) == (d1[k], d2[k]))
                found.append(s.tobytes() if right[-1] else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())],
                                             ["cid", "found"]).filter(pa.array(right, pa.bool_()))

    texts = _keyed(docs).withColumnRenamed("doc_id", "rep")
    return texts.join(wanted, ["rep", "t"]).select("cid", "text", "d1", "d2").mapInArrow(
        run, "cid long, found binary")


def _relabel(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """Column ``comp`` of every cid: its component, or itself."""
    return rows.join(comps.select(F.col("id").alias("cid"), F.col("component").alias("found_comp")),
                     "cid", "left").withColumn(
        "comp", F.coalesce("found_comp", "cid")).drop("found_comp")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row per input row.

    ``size``: words per shingle; ``percent``: least similarity, 100 * intersection / union.
    """
    return grouped(docs, size, percent).select("doc_id", "n_shingles", "component_id").withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with one row of every group: that with the smallest id, then text hash.

    Rows without an id come after all others. Rows without words are in no group and all stay. All
    columns come back as they were.
    """
    last = F.lit(2**63 - 1)
    named = docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), last),
                              "_t": F.xxhash64("text")})
    judged = written(grouped(docs.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), last)),
                             size, percent).select("doc_id", "t", "n_shingles", "group"),
                     "near-judged")
    first = judged.filter("n_shingles > 0").groupBy("group").agg(
        F.min(F.struct("doc_id", "t")).alias("one"), F.count(F.lit(1)).alias("n")).select(
        F.col("one.doc_id").alias("_id"), F.col("one.t").alias("_t"))
    blank = judged.filter("n_shingles = 0").select(F.col("doc_id").alias("_id"),
                                                   F.col("t").alias("_t")).distinct()
    most = judged.filter("n_shingles > 0").groupBy("doc_id", "t").count().agg(F.max("count")).first()[0]
    kept = named.join(first, ["_id", "_t"], "left_semi")
    if (most or 0) > 1:  # equal rows, of which one stays
        kept = kept.dropDuplicates(["_id", "_t"])
    return kept.unionByName(named.join(blank, ["_id", "_t"], "left_semi")).select(*docs.columns)


def grouped(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, t (a hash of the text), n_shingles, group (null without shingles) and component_id,
    one row per input row."""
    cut = cut_for(percent / 100)
    seen = written(features(docs, size), "near-features")
    usable = seen.filter("n_shingles > 0 and doc_id is not null")
    by_set = ["d1", "d2", "n_shingles"]
    classes = usable.groupBy(*by_set).agg(F.min(F.struct("doc_id", "t")).alias("one")).select(
        *by_set, F.col("one.doc_id").alias("rep"), F.col("one.t").alias("t"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "near-classes")
    one = usable.withColumnRenamed("doc_id", "rep").join(classes, [*by_set, "rep", "t"])
    one = written(one.select("cid", "bits", "bands").dropDuplicates(["cid"]), "near-signatures")

    # buckets, their centres, and one pair for every member and centre
    rows = one.select("cid", F.posexplode("bands").alias("band", "key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = written(rows.join(shared, "key"), "near-buckets")
    meets = members.groupBy("cid").agg(F.sum("n").alias("meets"))
    centres = (members.join(meets, "cid").groupBy("key")
               .agg(F.max(F.struct("meets", -F.col("cid"))).alias("c"))
               .select("key", (-F.col("c.col2")).alias("centre")))
    members = members.join(centres, "key")
    signature = one.select(F.col("cid").alias("b"), F.col("bits").alias("bits_b"))
    tried = (members.filter("cid <> centre").select(F.col("cid").alias("a"),
                                                    F.col("centre").alias("b")).distinct()
             .join(one.select(F.col("cid").alias("a"), "bits"), "a").join(signature, "b")
             .select("a", "b", (estimate(F.col("bits"), F.col("bits_b")) >= cut).alias("near")))
    tried = written(tried, "near-tried")

    # a bucket of two whose pair is out is done with
    spokes = members.join(tried.select(F.col("a").alias("cid"), F.col("b").alias("centre"), "near"),
                          ["cid", "centre"], "left")
    buckets = spokes.groupBy("key").agg(F.max("near").alias("near")).select("key", "near")
    members = written(members.join(buckets, "key").filter("n > 2 or near").select(
        "key", "band", "cid", "n"), "near-members")
    wanted = members.select("cid").distinct().join(
        classes.select("cid", "rep", "t", "d1", "d2"), "cid")
    sets = written(_sets_of(docs, wanted, size), "near-sets")
    links = written(_confirm(tried.filter("near").select("a", "b"), sets, percent), "near-links")
    comps = components(links)

    # what stars cannot decide
    labelled = written(_relabel(members.filter("n > 2"), comps), "near-labelled")
    split = labelled.groupBy("key").agg(
        F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("key")
    mixed = written(labelled.join(split, "key").join(
        classes.select("cid", "n_shingles"), "cid").select(
        "key", "band", "cid", "comp", "n_shingles"), "near-mixed")
    likely = written(_likely(_block_rows(mixed), one, cut), "near-likely")
    more = written(_joining(likely, sets, percent), "near-links")
    comps = written(components(links.unionByName(more)), "near-components")

    firsts = _relabel(classes, comps)
    least = firsts.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = firsts.join(least, "comp").select(*by_set, "component_id", F.col("comp").alias("group"))
    erase(one, tried, sets, members, labelled, mixed, likely, links, more)
    return seen.select("doc_id", "t", *by_set).join(named, by_set, "left").select(
        "doc_id", "t", "n_shingles", "group",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
        .alias("component_id"))
