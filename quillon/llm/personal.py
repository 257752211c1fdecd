"""Personal data in whole texts: proposed by patterns, confirmed by checksums, scored by context.

Regular expressions propose spans. Validators confirm them: Luhn for card numbers, remainder 97 for
bank accounts (IBAN), the weighted sum of routing numbers, the numbering rules of US social security
numbers, ranges and digit counts for addresses and phones. Words around a span move its score, and
kinds that look like plain numbers are reported only when context speaks for them.

===== ============================================= ================================ =====
kind  proposal                                      confirmed by                     alone
===== ============================================= ================================ =====
email local part, ``@``, two or more labels         its form                         0.9
ip    four runs of digits                           every part at most 255           0.6
card  digits, single spaces or hyphens between      12 to 19 digits, Luhn            0.8
phone ``+``, digits and marks                       9 to 15 digits                   0.7
iban  country, check digits, then 11 to 30 or fours remainder 1 modulo 97            0.9
ssn   ``ddd-dd-dddd``                               no 000, 666, 9xx; no 00; no 0000 0.3
aba   nine digits                                   weights 3, 7, 1 modulo 10        0.2
===== ============================================= ================================ =====

A span's score is its kind's own, plus 0.4 if a word for the kind stands in the 48 characters before
or 24 after it, less 0.3 if a word against it does, within 0 and 1. The first four kinds (base) are
always reported, with their score; the others if their score is at least 0.5.

Matching is linear in the text: e-mail addresses are found from their ``@``, and runs of digits are
taken whole. Matches of a kind are leftmost and do not overlap; a match that fails its check is
dropped without another try. Positions are code points, ends exclusive.

Defined cases: null text is empty; a text without finds has zero counts and empty lists; repeated
rows and repeated or null ids are judged row by row; an empty table gives no rows; other columns are
ignored. A text is held once in a task besides its finds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEFORE, AFTER, FOR, AGAINST, LEAST = 48, 24, 4, 3, 5
BASE = ("email", "ip", "card", "phone")
#: Own score of every kind in tenths, words for it and words against it. The order settles equal
#: starts.
KINDS = {
    "email": (9, ("email", "mail", "contact"), ("example",)),
    "ip": (6, ("ip", "address", "host", "server", "login"), ("version", "release", "section")),
    "card": (8, ("card", "credit", "visa", "mastercard", "payment"),
             ("isbn", "tracking", "order")),
    "phone": (7, ("phone", "tel", "call", "mobile", "fax"), ("order", "version")),
    "iban": (9, ("iban", "bank", "account", "bic", "swift"), ("serial",)),
    "ssn": (3, ("ssn", "social", "security", "taxpayer"), ("isbn", "part", "serial")),
    "aba": (2, ("routing", "aba", "bank", "transit"), ("isbn", "serial", "order")),
}
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_PATTERNS = {
    "ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": re.compile(r"[0-9](?:[ -]?+[0-9])++"),
    "phone": re.compile(r"\+[0-9][ ().0-9-]+[0-9]"),
    "iban": re.compile(r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: (?:"
                       r"[0-9][A-Z0-9]{0,2}|[A-Z][0-9][A-Z0-9]?|[A-Z]{2}[0-9]))?)\b", re.ASCII),
    "ssn": re.compile(r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", re.ASCII),
    "aba": re.compile(r"\b[0-9]{9}\b", re.ASCII),
}
_WORDS = {kind: tuple(re.compile(rf"\b(?:{'|'.join(words)})\b", re.ASCII)
                      for words in (good, bad)) for kind, (_, good, bad) in KINDS.items()}
_LOWER = {c: c + 32 for c in range(65, 91)}


class Span(NamedTuple):
    start: int
    order: int
    kind: str
    end: int
    tenths: int


def luhn(digits: str) -> bool:
    """Every second digit from the right doubled, digit sums added, divisible by ten."""
    values = [int(c) for c in reversed(digits)]
    return sum(values[::2] + [2 * v - 9 * (v > 4) for v in values[1::2]]) % 10 == 0


def mod97(account: str) -> bool:
    """The first four characters moved to the end, letters as 10 to 35, remainder 1 modulo 97."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _is_ip(found: str) -> bool:
    parts = [p.lstrip("0") for p in found.split(".")]
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in parts)


def _is_card(found: str) -> bool:
    digits = found.replace(" ", "").replace("-", "")
    return 12 <= len(digits) <= 19 and luhn(digits)


def _is_phone(found: str) -> bool:
    return 9 <= sum("0" <= c <= "9" for c in found) <= 15


def _is_ssn(found: str) -> bool:
    area, group, serial = found.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def _is_routing(found: str) -> bool:
    return sum(int(c) * w for c, w in zip(found, (3, 7, 1) * 3)) % 10 == 0 and found != "0" * 9


CHECKS = {"ip": _is_ip, "card": _is_card, "phone": _is_phone,
          "iban": lambda found: mod97(found.replace(" ", "")), "ssn": _is_ssn, "aba": _is_routing}


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses from their ``@``: the characters a local part may have before it, back to the end
    of the address before, and the domain after it."""
    last = 0
    for domain in _DOMAIN.finditer(text):
        at = start = domain.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            last = domain.end()
            yield start, last


def _proposed(text: str) -> Iterator[tuple[str, int, int]]:
    if "@" in text:
        for start, end in _emails(text):
            yield "email", start, end
    for kind, pattern in _PATTERNS.items():
        if kind == "phone" and "+" not in text:
            continue
        for match in pattern.finditer(text):
            if CHECKS[kind](match[0]):
                yield kind, match.start(), match.end()


def score(text: str, kind: str, start: int, end: int) -> int:
    """The kind's own score, moved by the words around the span, in tenths."""
    around = (text[max(0, start - BEFORE): start] + "\n" + text[end: end + AFTER]).translate(_LOWER)
    good, bad = _WORDS[kind]
    moved = KINDS[kind][0] + FOR * bool(good.search(around)) - AGAINST * bool(bad.search(around))
    return min(10, max(0, moved))


def spans(text: str) -> list[Span]:
    """Every reported span of a text, by start, then kind."""
    order = {kind: i for i, kind in enumerate(KINDS)}
    found = (Span(start, order[kind], kind, end, score(text, kind, start, end))
             for kind, start, end in _proposed(text))
    return sorted(s for s in found if s.kind in BASE or s.tenths >= LEAST)


_FOUND = ("doc_id long, found array<struct<kind: string, start: long, end: long, score: double, "
          "base: boolean>>")


def find(docs: DataFrame) -> DataFrame:
    """doc_id and ``found``: kind, start, end, score and whether it is a base kind, in order."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                               ("score", pa.float64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[{"kind": s.kind, "start": s.start, "end": s.end, "score": s.tenths / 10,
                      "base": s.kind in BASE} for s in spans(text.as_py() or "")]
                    for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)],
                                             ["doc_id", "found"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _FOUND)


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every reported span of ``text`` replaced by its kind in brackets; of spans that
    overlap the first stands. Null texts stay null."""
    at = docs.columns.index("text")

    def masked(text: str) -> str:
        out, last = [], 0
        for s in spans(text):
            if s.start >= last:
                out += [text[last: s.start], f"[{s.kind.upper()}]"]
                last = s.end
        return "".join(out) + text[last:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t.as_py() is None else masked(t.as_py()) for t in batch.column(at)]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores.

    ``spans`` lists kind:start:end of all finds, ``base_sha256`` is the digest of that list for the
    base kinds, ``scores`` lists the scores in the order of ``spans``.
    """
    kinds = [(f"n_{k}", pa.int64()) for k in BASE]
    schema = pa.schema([("doc_id", pa.int64()), *kinds, ("base_sha256", pa.string()),
                        ("spans", pa.string()), ("scores", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(1):
                found = spans(value.as_py() or "")
                shown = [f"{s.kind}:{s.start}:{s.end}" for s in found]
                base = [text for text, s in zip(shown, found) if s.kind in BASE]
                rows.append((*(sum(s.kind == k for s in found) for k in BASE),
                             hashlib.sha256(",".join(base).encode()).hexdigest(),
                             ",".join(shown), ",".join(str(s.tenths / 10) for s in found)))
            columns = list(zip(*rows)) or [()] * (len(schema) - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *(pa.array(c, schema.types[i + 1])
                                                     for i, c in enumerate(columns))], schema=schema)

    counts = ", ".join(f"n_{k} long" for k in BASE)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, f"doc_id long, {counts}, base_sha256 string, spans string, scores string")
