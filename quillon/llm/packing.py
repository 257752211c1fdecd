"""Best-fit packing of token sequences by hierarchical residual rounds.

Texts become pieces of at most ``capacity`` tokens; full pieces are sequences of their own. The rest
is packed in rounds: every group of items is packed best-fit decreasing by itself, bins with at most
``slack`` free tokens are final, and underfull bins become the items of the next round, in fewer
groups, until one group is left or regrouping no longer shrinks anything.

Defined cases: a null text is an empty one and makes a piece of the single end id; repeated rows and
repeated or null ids are packed row by row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.words import lists
from quillon.session import written

CAPACITY = 2048
END_ID = 0
CACHE_WORDS = 1_000_000
#: The rules of a vocabulary of lower-cased words, as its file states them.
SPLITTING = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
        {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|"
                                               r"[^\s\p{L}\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
_PIECES = ("doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


def _byte_letters() -> dict[int, str]:
    """The visible letter that byte-level vocabularies use for each byte: itself if it is printable,
    else the next free one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordIds(dict):
    """Token ids, as little-endian bytes, of words between white space, kept once looked up.

    A vocabulary whose file has the ``SPLITTING`` rules never joins text across white space, nor a
    letter and a mark after it. So a word of Latin letters (before U+0250, where lower-casing and
    composition leave nothing to decide) and perhaps a few marks at its end goes to the merge table
    directly; all others take the whole path. With any other file whole texts do.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        rules = json.loads(self.tokenizer.to_str())
        self.splits = (all(rules.get(k) == v for k, v in SPLITTING.items())
                       and rules["model"].get("type") == "BPE")

    def __missing__(self, word: bytes) -> bytes:
        stem = word.rstrip(b".,;:!?")
        text = stem.decode()
        if text.isalpha() and max(text) < "\u0250" and text.lower().isalpha():
            mapped = text.lower().encode().decode("latin-1").translate(self.letters)
            found = [t.id for t in self.tokenizer.model.tokenize(mapped)]
            ids = np.array(found, "<u4").tobytes()
            if len(stem) < len(word):
                ids += self[word[len(stem):]]
        else:
            found = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
            ids = np.array(found, "<u4").tobytes()
        self[word] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        if len(self) > CACHE_WORDS:
            self.clear()
        if not self.splits:
            found = self.tokenizer.encode(text.decode(), add_special_tokens=False).ids
            return np.array(found, "<u4").tobytes()
        return b"".join(map(self.__getitem__, text.split()))


_ENCODERS: dict[str, WordIds] = {}


def _encoder(path: str) -> WordIds:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _ENCODERS:
        _ENCODERS[path] = WordIds(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
           keep_ids: bool = False) -> DataFrame:
    """One row per piece: where it starts in its text's ids, how long it is, a checksum of its ids
    and, on request, the ids themselves (little-endian 32-bit)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            texts = batch.column(1).fill_null("").cast(pa.binary())
            for i in range(0, len(keys), 256):
                rows = []
                part = texts[i: i + 256].to_pylist()
                for key, text in zip(keys[i: i + 256], part, strict=True):
                    ids = encoder.encode(text) + end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[at: at + 4 * capacity]
                        rows.append((key, k, at // 4, len(piece) // 4, zlib.crc32(piece),
                                     piece if keep_ids else None))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    cut_up = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, _PIECES)
    return cut_up if keep_ids else cut_up.drop("ids")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Bin of each item, largest first into the tightest bin that holds it; number of bins."""
    place, count = np.empty(len(sizes), np.int64), 0
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit f: some bin has exactly f free
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = with_room[free].pop()
            if not with_room[free]:
                mask &= ~(1 << free)
        else:
            b, free, count = count, capacity, count + 1
        place[i] = b
        if free > size:
            with_room[free - size].append(b)
            mask |= 1 << (free - size)
    return place, count


_BINS = "bin long, fill long, uids array<long>, offsets array<long>"


def _round(items: DataFrame, n_groups: int, capacity: int) -> DataFrame:
    """One best-fit round over items that are bins themselves."""

    def fill(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        sizes = table["fill"].to_numpy()
        place, count = best_fit(sizes, capacity)
        order = np.lexsort((-sizes, place))
        table, place, sizes = table.take(pa.array(order)), place[order], sizes[order]
        first = np.searchsorted(place, np.arange(count))
        before = np.cumsum(sizes) - sizes
        base = before - before[first][place]
        uids, offsets = table["uids"].combine_chunks(), table["offsets"].combine_chunks()
        members = np.diff(uids.offsets.to_numpy())
        per_bin = np.add.reduceat(members, first)
        flat = uids.flatten().to_numpy()
        shifted = offsets.flatten().to_numpy() + np.repeat(base, members)
        heads = flat[np.cumsum(per_bin) - per_bin]
        return pa.table({"bin": heads, "fill": np.add.reduceat(sizes, first),
                         "uids": lists(flat, per_bin), "offsets": lists(shifted, per_bin)})

    group = F.pmod(F.xxhash64("bin"), F.lit(n_groups)).alias("group")
    return items.select(group, "bin", "fill", "uids", "offsets").groupBy("group").applyInArrow(
        fill, _BINS)


def assign(pieces: DataFrame, capacity: int = CAPACITY, per_group: int = 50_000,
           fan_in: int = 4, slack: int = 16) -> DataFrame:
    """(uid, sequence_id, offset) for pieces (uid, length). ``sequence_id`` is the first member's uid.

    Groups hold about ``per_group`` items, so no task gets more than that whatever the sizes are.
    """
    full = pieces.filter(F.col("length") >= capacity).select(
        "uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = pieces.filter(F.col("length") < capacity)
    waiting = left.select(F.col("uid").alias("bin"), F.col("length").cast("long").alias("fill"),
                          F.array("uid").alias("uids"),
                          F.array(F.lit(0).cast("long")).alias("offsets"))
    n_groups = max(1, math.ceil(left.count() / per_group))
    done = []
    while True:
        bins = written(_round(waiting, n_groups, capacity), "packing-round")
        underfull = F.col("fill") < capacity - slack
        n_left = bins.filter(underfull).count()
        fewer = max(math.ceil(n_groups / fan_in), math.ceil(n_left / per_group))
        if n_groups == 1 or n_left == 0 or fewer >= n_groups:
            done.append(bins)
            break
        done.append(bins.filter(~underfull))
        waiting, n_groups = bins.filter(underfull), fewer
    members = None
    for part in done:
        members = part if members is None else members.unionByName(part)
    placed = members.select(
        F.col("bin").alias("sequence_id"),
        F.explode(F.arrays_zip("uids", "offsets")).alias("m")).select(
        F.col("m.uids").alias("uid"), "sequence_id", F.col("m.offsets").alias("offset"))
    return placed.unionByName(full.select("uid", "sequence_id", "offset"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
         keep_ids: bool = False) -> DataFrame:
    """Every piece of every text with its sequence and its place there."""
    cut = pieces(docs, tokenizer, capacity, end_id, keep_ids)
    cut = written(cut.withColumn("uid", F.monotonically_increasing_id()), "packing-pieces")
    return cut.join(assign(cut, capacity), "uid").drop("uid")


