"""Licence scan with a positional index of rare licence words.

Every template is a sequence of words with a mandatory key phrase in it. One pass over the texts
notes which licence words each file holds; from that come the words' document frequencies over all
files. The index holds, for every template, the places of the two key-phrase words with the highest
inverse document frequency. A file's occurrences of index words are joined to the postings, the
difference of the two places is the template's offset in the file, and an offset is a candidate if
all postings of the template agree on it. Candidates are verified: the key phrase must stand there
word for word, and at least ``share`` of the whole template.

Only DataFrame expressions, aggregates and joins run; the templates (a fixed list) are the only
thing broadcast. A hit carries the words around it, so no text is joined back.

Defined cases: A-Z are lower-cased; words are runs of digits, a-z and non-ASCII characters; a null
text has no words; a file without a match has score 0 and empty labels; repeated rows repeat; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.session import written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
BASE = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]
#: label, key phrase, whole template. The key phrase stands in the template once.
NOTICES = [
    ("apache-2.0", "apache license version 2 0", "licensed under the apache license version 2 0"),
    ("gpl-3.0", "general public license version 3",
     "licensed under the gnu general public license version 3"),
    ("gpl-2.0", "general public license version 2",
     "licensed under the gnu general public license version 2"),
    ("lgpl", "lesser general public license", "gnu lesser general public license"),
    ("mpl-2.0", "mozilla public license", "mozilla public license version 2 0"),
    ("mit-notice", "released under the mit license", "released under the mit license"),
    ("mit-text", "permission is hereby granted free of charge",
     "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd", "redistribution and use in source and binary forms",
     "redistribution and use in source and binary forms with or without modification are "
     "permitted"),
    ("cc-by-nc-4.0", "cc by nc 4 0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "cc by sa 4 0", "licensed under cc by sa 4 0"),
    ("cc-by-4.0", "cc by 4 0", "licensed under cc by 4 0"),
]
SHARE, RARE = 0.6, 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def templates() -> list[dict]:
    out = [{"t": t, "label": label, "base": True, "key": phrase.split(), "start": 0,
            "body": phrase.split()} for t, (label, phrase) in enumerate(BASE)]
    for label, key, body in NOTICES:
        key, body = key.split(), body.split()
        start = next(i for i in range(len(body)) if body[i: i + len(key)] == key)
        out.append({"t": len(out), "label": label, "base": False, "key": key, "start": start,
                    "body": body})
    return out


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _words_of(docs: DataFrame, known: list[dict]) -> DataFrame:
    """Per row: word count, licence words present, and all words where a whole key phrase's are."""
    lower = F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER)
    vocabulary = sorted({w for t in known for w in t["body"]})
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)).alias("words"))
    found = split.select("doc_id", "words", F.size("words").cast("long").alias("n_words"),
                         F.array_intersect("words", _strings(vocabulary)).alias("present"))
    possible = F.lit(False)
    for t in known:
        possible = possible | (F.size(F.array_except(_strings(t["key"]), "present")) == 0)
    return found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", "present",
                        F.when(possible, F.col("words")).alias("words"))


def rarity(seen: DataFrame) -> dict[str, float]:
    """Inverse document frequency of every licence word, over all files; at most one number for each
    word of the templates comes back."""
    total = seen.count()
    counts = seen.select(F.explode("present").alias("w")).groupBy("w").count().collect()
    return {r["w"]: math.log((total + 1) / (r["count"] + 1)) for r in counts}


def places(seen: DataFrame, known: list[dict], rare: int, share: float) -> DataFrame:
    """Verified places: row, label, base, first word and matched share of the template."""
    spark, idf = seen.sparkSession, rarity(seen)
    postings, rows = [], []
    for t in known:
        best = sorted(set(t["key"]), key=lambda w: (-idf.get(w, math.inf), w))[:rare]
        at = [t["start"] + i for i, w in enumerate(t["key"]) if w in best]
        postings += [(t["body"][i], t["t"], i) for i in at]
        rows.append((t["t"], t["label"], t["base"], t["start"], t["key"], t["body"], len(at)))
    index = spark.createDataFrame(postings, "word string, t int, rel int")
    about = spark.createDataFrame(rows, "t int, label string, base boolean, start int, "
                                        "key array<string>, body array<string>, needed int")
    reach = max(len(t["body"]) for t in known)
    low = F.greatest(F.col("pos") - reach, F.lit(0))
    hits = (seen.filter("words is not null").select("row", "words",
                                                    F.posexplode("words").alias("pos", "word"))
            .filter(F.col("word").isin(sorted({w for w, _, _ in postings})))
            .select("row", "pos", "word", low.alias("low"),
                    F.slice("words", low + 1, F.lit(2 * reach + 1)).alias("around")))
    agreed = (hits.join(F.broadcast(index), "word")
              .groupBy("row", "t", (F.col("pos") - F.col("rel")).alias("offset"))
              .agg(F.count(F.lit(1)).alias("hits"), F.min(F.struct("low", "around")).alias("c"))
              .join(F.broadcast(about), "t").filter("hits = needed"))
    shift = F.col("offset") - F.col("c.low")
    same = F.filter("body", lambda w, k: F.coalesce(F.get("c.around", shift + k) == w,
                                                    F.lit(False)))
    stands = F.slice("c.around", F.greatest(shift + F.col("start") + 1, F.lit(1)), F.size("key"))
    return agreed.filter(stands == F.col("key")).select(
        "row", "label", "base", F.col("offset").cast("long").alias("offset"),
        (F.size(same) / F.size("body")).alias("share")).filter(F.col("share") >= share)


def scan(docs: DataFrame, rare: int = RARE, share: float = SHARE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score per row."""
    known = templates()
    seen = written(_words_of(docs, known), "license-words")
    base = F.col("base")
    listed = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    per_row = places(seen, known, rare, share).groupBy("row").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("offset"))).alias("first_word"),
        F.max(F.when(base, F.col("offset"))).alias("last_word"),
        listed(F.when(base, F.col("label"))).alias("base_labels"),
        listed(F.col("label")).alias("labels"), F.max("share").alias("score"))
    return seen.select("row", "doc_id", "n_words").join(per_row, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
