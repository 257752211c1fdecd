"""Character runs of whole texts, taken in bounded slices, for operators that count terms in tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa

SLICE = 1 << 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def lowered(column: pa.Array) -> Iterator[str]:
    """The texts of a column with only A-Z lower-cased, one at a time; null counts as empty."""
    for value in column.cast(pa.large_binary()):
        yield (value.as_py() or b"").translate(_LOWER).decode()


def slices(text: str, outside: re.Pattern) -> Iterator[tuple[int, int]]:
    """Stretches of about a million characters that end where ``outside`` stands, so that no run is
    cut; only a run longer than that makes a longer stretch."""
    at = 0
    while at < len(text):
        end = min(at + SLICE, len(text))
        if end < len(text):
            gap = outside.search(text, end)
            end = gap.start() if gap else len(text)
        yield at, end
        at = end
