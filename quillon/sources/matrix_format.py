"""``spark.read.format("matrix")``: rows of a matrix file as ``vec_id, embedding``.

``.npy`` files are cut into row ranges, text files into byte ranges; every partition reads its own
range. A text row's number needs the rows before its range: ``matrices.read_matrix`` counts them in a
Spark job and passes them as the option ``rows_before``; without it the planner counts them itself,
up to ``MOST_COUNTED`` bytes.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PART_BYTES, MOST_COUNTED, LINE_BLOCK = 32 << 20, 1 << 30, 8 << 20
SCHEMA = "vec_id bigint, embedding array<float>"


def opened(path: str):
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    system, inner = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return system.open_input_file(inner)


def npy_header(handle) -> tuple[int, int, bool, np.dtype, int]:
    """Rows, width, whether stored by columns, type, and the place of the first number."""
    version = np.lib.format.read_magic(handle)
    read = (np.lib.format.read_array_header_1_0 if version == (1, 0)
            else np.lib.format.read_array_header_2_0)
    shape, by_columns, kind = read(handle)
    rows, width = (shape[0], shape[1]) if len(shape) == 2 else (1, shape[0])
    return rows, width, by_columns, kind, handle.tell()


def npy_rows(handle, header: tuple, first: int, count: int) -> np.ndarray:
    rows, width, by_columns, kind, start = header
    size = kind.itemsize
    if not by_columns:
        handle.seek(start + first * width * size)
        return np.frombuffer(handle.read(count * width * size), kind).reshape(count, width)
    columns = []
    for c in range(width):
        handle.seek(start + (c * rows + first) * size)
        columns.append(np.frombuffer(handle.read(count * size), kind))
    return np.stack(columns, axis=1)


def lines_from(handle, first: int, end: int) -> Iterator[bytes]:
    """The lines that start in ``first .. end``, read to their ends."""
    at = max(0, first - 1)
    handle.seek(at)
    rest, begun = b"", first == 0
    while at < end or rest:
        block = handle.read(LINE_BLOCK)
        parts = (rest + block).split(b"\n")
        rest = parts.pop() if block else b""
        for line in parts:
            if begun:
                if at >= end:
                    return
                yield line
            begun = True
            at += len(line) + 1
        if not block:
            return


def numbers(line: bytes) -> list[float] | None:
    """The numbers of a line, None for a blank one; a comment after ``#`` does not count."""
    found = line.split(b"#", 1)[0].split()
    return [float(x) for x in found] if found else None


@dataclass
class Part(InputPartition):
    first: int
    end: int
    before: int


class MatrixSource(DataSource):
    """Options: ``path``, ``part_bytes`` (of a partition), ``rows_before`` (JSON list, see above)."""

    @classmethod
    def name(cls) -> str:
        return "matrix"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return MatrixReader(self.options)


class MatrixReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.part_bytes = int(options.get("part_bytes", PART_BYTES))
        self.rows_before = json.loads(options.get("rows_before", "null"))

    def partitions(self) -> list[Part]:
        with opened(self.path) as handle:
            if self.path.endswith(".npy"):
                rows, width, _, kind, _ = npy_header(handle)
                step = max(1, self.part_bytes // max(1, width * kind.itemsize))
                return [Part(i, min(i + step, rows), i) for i in range(0, rows, step)]
            cuts = byte_ranges(handle.size(), self.part_bytes)
            before = self.rows_before
            if before is None:
                if handle.size() > MOST_COUNTED:
                    raise ValueError("text too large to number here: use matrices.read_matrix")
                counts = [sum(numbers(x) is not None for x in lines_from(handle, a, b))
                          for a, b in cuts]
                before = [sum(counts[:i]) for i in range(len(counts))]
            return [Part(a, b, n) for (a, b), n in zip(cuts, before, strict=True)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        with opened(self.path) as handle:
            if self.path.endswith(".npy"):
                found = npy_rows(handle, npy_header(handle), part.first, part.end - part.first)
                yield _batch(part.before, list(found.astype(np.float32)))
                return
            held, at = [], part.before
            for line in lines_from(handle, part.first, part.end):
                row = numbers(line)
                if row is not None:
                    held.append(row)
                if len(held) == 8192:
                    yield _batch(at, held)
                    held, at = [], at + len(held)
            if held:
                yield _batch(at, held)


def byte_ranges(size: int, part_bytes: int) -> list[tuple[int, int]]:
    n = max(1, math.ceil(size / part_bytes))
    return [(i * part_bytes, min(size, (i + 1) * part_bytes)) for i in range(n)]


def _batch(first: int, rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(first, first + len(rows), dtype=np.int64)),
         pa.array(rows, pa.list_(pa.float32()))], ["vec_id", "embedding"])
