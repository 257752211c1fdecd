"""Removal of passages that an earlier document holds too, by repeated-phrase automata.

A window is ``window`` consecutive words. The phrase of a window is the one of its runs of
``phrase`` words with the least hash, so equal windows have equal phrases and a document has about
one phrase per twenty words.

1. One pass over the texts gives each document's phrases and a digest of its words. Documents with
   equal words are one class; later ones of a class are copies and need no search.
2. Phrases in two documents or more recur. All windows of a document with the same phrase are a
   span. Documents that agree on a whole span (128 bits) confirm its windows; where the spans of a
   phrase differ, the windows of one document per span are compared one by one. The smallest id
   that holds a window is noted.
3. Documents with recurring phrases are dealt to shards by their id and text. Each shard gets the
   confirmed phrases and spans that its documents hold, compiles one Aho-Corasick automaton and
   streams its documents' whole texts through it. Every occurrence the automaton reports gives the
   windows around it; those whose phrase it is are looked up in the confirmed spans, and what is
   confirmed is marked. A place that the automaton does not report is never looked at. A shard's automaton never outgrows the shard's own texts, whatever
   the corpus holds. Documents without a recurring phrase have nothing to find.

Defined cases: words are runs other than space and 09-0D, null is a text without words; a text
shorter than a window keeps all; windows are those of the input; repeated rows are judged alike and
repeat; a null id counts as larger than any other, and nulls are equal; an empty table gives no
rows; extra columns are ignored (``remove`` returns them).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import words
from quillon.session import erase, written

WINDOW, PHRASE = 50, 8
SHARD_BYTES = 8 << 20
BROADCAST_PHRASES = 1 << 22
ROWS_AT_ONCE = 1 << 16
_LAST = 2**63 - 1
_EMPTY = hashlib.sha256(b"").hexdigest()


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    if len(values) < width:
        return values[:0]
    least, have = values, 1
    while have * 2 <= width:
        least, have = np.minimum(least[:-have], least[have:]), have * 2
    rest = width - have
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def chosen_phrases(runs: words.Runs, total: int, at: np.ndarray, window: int, phrase: int):
    """Start of every window inside one text, its text, and its phrase; all phrases' hashes."""
    hashed = runs.of(np.arange(max(0, total - phrase + 1)), phrase)
    least = sliding_least(hashed, window - phrase + 1)
    n = np.diff(at)
    room = np.maximum(n - window + 1, 0)
    owner = np.repeat(np.arange(len(n)), room)
    start = at[owner] + np.arange(int(room.sum())) - np.repeat(np.cumsum(room) - room, room)
    return start, owner, least[start], hashed


def _keyed(docs: DataFrame) -> DataFrame:
    """Row identity: the id, null as the largest, a hash of the text, and whether there is an id."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"),
                       F.xxhash64("text").alias("t"), "text",
                       F.col("doc_id").cast("long").isNotNull().alias("named"))


def features(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = words.raw(batch.column(2))
            for first, _, starts, _, at, hashed in words.texts(batch.column(2), lower=False):
                n = np.diff(at)
                rows = batch.slice(first, len(n))
                runs = [words.Runs(hashed, lane) for lane in (0, 1)]
                start, owner, least, _ = chosen_phrases(runs[0], len(starts), at, window, phrase)
                new = np.ones(len(least), bool)
                new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
                owner, least = owner[new], least[new]
                order = np.lexsort((least, owner))
                owner, least = owner[order], least[order]
                new = np.ones(len(least), bool)
                new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
                owner, least = owner[new], least[new]
                whole = [words.signed(r.of(at[:-1], n)) for r in runs]
                sha, size = [], []
                for i in range(first, first + len(n)):
                    text = data[ends[i]: ends[i + 1]].tobytes()
                    sha.append(hashlib.sha256(b" ".join(text.split())).hexdigest())
                    size.append(len(text))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), rows.column(3), pa.array(n, pa.int64()),
                     pa.array(whole[0]),
                     pa.array(whole[1]), pa.array(sha), pa.array(size, pa.int64()),
                     words.lists(words.signed(least), np.bincount(owner, minlength=len(n)))],
                    ["id", "t", "named", "n_words", "d1", "d2", "sha", "n_bytes", "phrases"])

    return _keyed(docs).mapInArrow(
        run, "id long, t long, named boolean, n_words long, d1 long, d2 long, sha string, "
             "n_bytes long, phrases array<long>")


def _spans_at(runs, chosen, hit: np.ndarray, window: int):
    """The windows numbered ``hit``, by phrase: the phrase, the starts of its windows, their hashes
    and the digest of all of them: a span."""
    start, _, least, _ = chosen
    hit = hit[np.argsort(least[hit], kind="stable")]
    values, heads = np.unique(least[hit], return_index=True)
    hashed = [r.of(start[hit], window) for r in runs]
    number = np.arange(len(hit), dtype=np.uint64)
    for value, x, y in zip(values, heads, np.append(heads, len(hit))[1:], strict=True):
        digest = [int(words.mix(h[x:y] + words.mix(number[: y - x])).sum().view(np.int64))
                  for h in hashed]
        yield value, start[hit[x:y]], [words.signed(h[x:y]) for h in hashed], digest


def _text_spans(runs, k: int, chosen, phrases: np.ndarray, window: int):
    """Spans of text ``k`` of a slice that have one of ``phrases``."""
    _, owner, least, _ = chosen
    a, b = np.searchsorted(owner, [k, k + 1])
    yield from _spans_at(runs, chosen, a + np.flatnonzero(np.isin(least[a:b], phrases)), window)


def _spans_around(runs, k: int, chosen, places: np.ndarray, phrases: np.ndarray, window: int,
                  phrase: int):
    """Spans of text ``k`` whose windows hold one of the reported (place, phrase) as their own."""
    start, owner, least, _ = chosen
    a, b = np.searchsorted(owner, [k, k + 1])
    if a == b or not len(places):
        return
    first = np.maximum(places - (window - phrase), 0)
    last = np.minimum(places, b - a - 1)
    size = np.maximum(last - first + 1, 0)
    around = np.repeat(first, size) + np.arange(int(size.sum())) - np.repeat(
        np.cumsum(size) - size, size)
    mine = around[least[a + around] == np.repeat(phrases, size)]
    yield from _spans_at(runs, chosen, a + np.unique(mine), window)


def _per_text(column: pa.Array, window: int, phrase: int):
    """(row, bytes, word starts, word ends, first word, word after, phrase hashes, spans of phrases,
    spans around places) for every text of a column."""
    for first, data, starts, ends, at, hashed in words.texts(column):
        runs = [words.Runs(hashed, lane) for lane in (0, 1)]
        chosen = chosen_phrases(runs[0], len(starts), at, window, phrase)
        for k in range(len(at) - 1):
            yield (first + k, data, starts, ends, at[k], at[k + 1], chosen[3],
                   lambda wanted, k=k: _text_spans(runs, k, chosen, wanted, window),
                   lambda places, found, k=k: _spans_around(runs, k, chosen, places, found, window,
                                                            phrase))


def _spans(texts: DataFrame, window: int, phrase: int) -> DataFrame:
    """Per document and recurring phrase: the phrase as text and the digest of its windows."""
    kinds = [("shard", pa.int64()), ("id", pa.int64()), ("p", pa.int64()),
             ("phrase", pa.string()), ("s1", pa.int64()), ("s2", pa.int64()), ("t", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, data, starts, ends, _, _, every, spans, _ in _per_text(
                    batch.column(2), window, phrase):
                wanted = batch.column(3)[row].values.to_numpy().view(np.uint64)
                for value, begin, _, digest in spans(wanted):
                    s = begin[0]
                    p = s + int((every[s: s + window - phrase + 1] == value).argmax())
                    text = b" ".join(data[starts[q]: ends[q]].tobytes()
                                     for q in range(p, p + phrase)).decode()
                    rows.append((batch.column(0)[row].as_py(), batch.column(1)[row].as_py(),
                                 int(value.view(np.int64)), text, *digest,
                                 batch.column(4)[row].as_py()))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, kind) for c, (_, kind) in
                     zip(zip(*rows, strict=True), kinds, strict=True)], [k for k, _ in kinds])

    return texts.select("shard", "id", "text", "phrases", "t").mapInArrow(
        run, "shard long, id long, p long, phrase string, s1 long, s2 long, t long")


def _windows(texts: DataFrame, window: int, phrase: int) -> DataFrame:
    """The windows of the given spans (phrase, lowest and highest document), one row each."""
    names = ["sid", "k", "h1", "h2", "low", "high"]

    def table(parts: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*parts, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, held = [], 0
            for row, _, _, _, _, _, _, spans, _ in _per_text(batch.column(0), window, phrase):
                given = {(g["p"], g["s1"], g["s2"]): g for g in batch.column(1)[row].as_py()}
                wanted = np.array([g[0] for g in given], np.int64).view(np.uint64)
                for value, begin, (one, two), digest in spans(wanted):
                    g, n = given.get((int(value.view(np.int64)), *digest)), len(begin)
                    if g is not None:
                        parts.append([np.full(n, g["sid"]), np.arange(n), one, two,
                                      np.full(n, g["low"]), np.full(n, g["high"])])
                        held += n
                if held > ROWS_AT_ONCE:
                    yield table(parts)
                    parts, held = [], 0
            if parts:
                yield table(parts)

    return texts.select("text", "given").mapInArrow(
        run, ", ".join(f"{n} long" for n in names))


def _cut(text: str, gone: np.ndarray) -> str:
    """The text without the words marked ``gone`` and the white space after each."""
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = words.places(data, np.array([0, len(data)]))
    after = np.append(starts[1:], ends[-1])
    keep = np.ones(len(data), bool)
    for i in np.flatnonzero(gone):
        keep[starts[i]: after[i]] = False
    return data[keep].tobytes().decode()


_KEPT = [("id", pa.int64()), ("t", pa.int64()), ("n_removed", pa.int64()),
         ("kept_sha256", pa.string()), ("kept", pa.string())]


def search_shard(left: pa.Table, right: pa.Table, window: int, phrase: int,
                 keep_text: bool) -> pa.Table:
    """What every document of a shard keeps, after the shard's automaton has found all places.

    ``left``: id, t, text; ``right``: phrase (text), p, s1, s2 and the smallest ids per window.
    """
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for text, value in zip(right["phrase"].to_pylist(), right["p"].to_pylist(), strict=True):
        automaton.add_word(f" {text} ", value)
    automaton.make_automaton()
    known = dict(zip(zip(*(right[c].to_pylist() for c in ("p", "s1", "s2")), strict=True),
                     right["least"].to_pylist(), strict=True))
    out = {name: [] for name, _ in _KEPT}
    for row, data, starts, ends, a, b, _, _, around in _per_text(left["text"], window, phrase):
        own_id, n, gone = left["id"][row].as_py(), b - a, np.zeros(0, bool)
        mine = [data[x:y].tobytes() for x, y in zip(starts[a:b], ends[a:b], strict=True)]
        line = (b" " + b" ".join(mine) + b" ").decode()
        hits = list(automaton.iter(line)) if len(automaton) else []
        # the space after a phrase is a boundary: its number is that of the word after it
        spaces = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), "<u4") == 32)
        ended = np.array([end for end, _ in hits], np.int64)
        places = np.searchsorted(spaces, ended) - phrase
        found = np.array([value for _, value in hits], np.int64).view(np.uint64)
        edge = np.zeros(n + 1, np.int64)
        for value, begin, _, digest in around(places, found):
            least = known.get((int(value.view(np.int64)), *digest))
            if least is not None:
                earlier = begin[np.array(least) < own_id] if len(least) == len(begin) else (
                    begin if least[0] < own_id else begin[:0])
                np.add.at(edge, earlier - a, 1)
                np.add.at(edge, earlier - a + window, -1)
        gone = np.cumsum(edge)[:-1] > 0
        kept = b" ".join(w for w, g in zip(mine, gone, strict=True) if not g)
        out["id"].append(own_id)
        out["t"].append(left["t"][row].as_py())
        out["n_removed"].append(int(gone.sum()))
        out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        out["kept"].append(_cut(left["text"][row].as_py(), gone) if keep_text and gone.any() else None)
    return pa.table(out, pa.schema(_KEPT))


def _search(texts: DataFrame, confirmed: DataFrame, window: int, phrase: int,
            keep_text: bool) -> DataFrame:
    """``search_shard`` of every shard."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return search_shard(left, right, window, phrase, keep_text)

    return texts.groupBy("shard").cogroup(confirmed.groupBy("shard")).applyInArrow(
        run, "id long, t long, n_removed long, kept_sha256 string, kept string")


def _confirmed(texts: DataFrame, spans: DataFrame, window: int, phrase: int) -> DataFrame:
    """Per shard: the spans its documents hold, their phrases, and the smallest document that holds
    each window of the span; a single number if that is the same for all windows.

    Documents that agree on a whole span confirm each other's windows. Only phrases with different
    spans are looked into window by window, and of each different span one document's.
    """
    span = ["p", "s1", "s2"]
    ends = spans.groupBy(*span).agg(F.min(F.struct("id", "t")).alias("one"), F.max("id").alias(
        "high")).select(*span, F.col("one.id").alias("low"), F.col("one.t").alias("t"), "high")
    kinds = ends.groupBy("p").agg(F.count(F.lit(1)).alias("n_spans"))
    ends = written(ends.join(kinds, "p").withColumn("sid", F.monotonically_increasing_id()),
                   "repeat-ends")
    alone = ends.filter("n_spans = 1").select(*span, F.array("low").alias("least"))
    given = ends.filter("n_spans > 1").groupBy(F.col("low").alias("id"), "t").agg(
        F.collect_list(F.struct(*span, "sid", "low", "high")).alias("given"))
    each = written(_windows(texts.join(given, ["id", "t"]), window, phrase), "repeat-windows")
    held = each.groupBy("h1", "h2").agg(F.min("low").alias("least"), F.max("high").alias("top"))
    least = F.when(F.col("least") < F.col("top"), F.col("least")).otherwise(F.lit(_LAST))
    looked_up = each.select("sid", "k", "h1", "h2").join(held, ["h1", "h2"]).groupBy("sid").agg(
        F.sort_array(F.collect_set(F.struct("k", least.alias("least")))).alias("w"))
    several = ends.join(looked_up, "sid").select(*span, F.col("w.least").alias("least"))
    local = spans.groupBy("shard", *span).agg(
        F.min("phrase").alias("phrase"), F.max("id").alias("top"))
    return local.join(alone.unionByName(several), span).filter(
        F.array_min("least") < F.col("top")).drop("top")


def decide(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE,
           keep_text: bool = False) -> DataFrame:
    """Per row: id, t, named, n_words, n_removed, kept_sha256 and, on request, what is left of the text
    (null where nothing goes)."""
    seen = written(features(docs, window, phrase), "repeat-features")
    long = seen.filter(F.col("n_words") >= window)
    by_words = ["d1", "d2", "n_words"]
    classes = written(long.groupBy(*by_words).agg(F.min("id").alias("first")), "repeat-classes")
    firsts = long.withColumn("first", F.col("id")).join(classes, [*by_words, "first"])
    firsts = written(firsts.select("id", "t", "phrases"), "repeat-firsts")
    held = firsts.select("id", "t", F.explode("phrases").alias("p"))
    recurring = held.groupBy("p").agg(F.min("id").alias("x"), F.max("id").alias("y")).filter(
        "x < y").select("p")
    wanted = written(held.join(recurring, "p").groupBy("id", "t").agg(
        F.collect_set("p").alias("phrases")), "repeat-wanted")
    erase(firsts)
    sizes = seen.groupBy("id", "t").agg(F.first("n_bytes").alias("n_bytes"),
                                        F.count(F.lit(1)).alias("n"))
    amount, most = wanted.join(sizes, ["id", "t"]).agg(F.sum("n_bytes"), F.max("n")).first()
    n_shards = max(1, math.ceil((amount or 0) / SHARD_BYTES))
    n_phrases = wanted.agg(F.sum(F.size("phrases"))).first()[0] or 0
    rows = wanted if n_phrases > BROADCAST_PHRASES else F.broadcast(wanted)
    texts = _keyed(docs).drop("named").join(rows, ["id", "t"])
    texts = texts.dropDuplicates(["id", "t"]) if (most or 0) > 1 else texts  # equal rows once
    texts = written(texts.withColumn(
        "shard", F.pmod(F.xxhash64("id", "t"), F.lit(n_shards))), "repeat-texts")
    spans = written(_spans(texts, window, phrase), "repeat-spans")
    found = written(_search(texts, _confirmed(texts, spans, window, phrase), window, phrase,
                            keep_text).dropDuplicates(["id", "t"]), "repeat-found")
    erase(wanted, texts, spans)
    copy = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    return (seen.drop("phrases", "n_bytes").join(classes, by_words, "left")
            .join(found, ["id", "t"], "left")
            .select("id", "t", "named", "n_words",
                    F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
                    .cast("long").alias("n_removed"),
                    F.when(copy, F.lit(_EMPTY)).otherwise(F.coalesce("kept_sha256", "sha"))
                    .alias("kept_sha256"),
                    F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept")))


def report(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, one row per input row."""
    return decide(docs, window, phrase).select(
        F.when(F.col("named"), F.col("id")).alias("doc_id"), "n_words", "n_removed",
        "kept_sha256")


def remove(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """``docs`` with repeated words cut out of ``text``; all columns and other white space stay."""
    left = decide(docs, window, phrase, keep_text=True).filter("n_removed > 0").select(
        F.col("id").alias("_row_id"), F.col("t").alias("_row_t"), F.col("kept").alias("_kept"))
    left = left.dropDuplicates(["_row_id", "_row_t"])
    same = ((F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)) == F.col("_row_id"))
            & (F.xxhash64("text") == F.col("_row_t")))
    return docs.join(left, same, "left").withColumn(
        "text", F.coalesce("_kept", "text")).select(*docs.columns)
