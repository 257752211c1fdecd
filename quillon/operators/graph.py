"""Proximity graph over earlier rows, and beam search through it for all queries together."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon import constants as C
from quillon.operators import blocks
from quillon.operators.blocks import row_distance
from quillon.operators.neighbours import knn
from quillon.session import erase, written
from quillon.sources.tables import spread

#: Links of a packed row, and most blocks whose sizes are broadcast; bytes of queries that a task holds.
PART_ROWS, FEW_BLOCKS, QUERY_BYTES = 16_384, 100_000, 32 << 20
#: Queries that walk together in a task, and what their marks of seen nodes may take.
WALKS_AT_ONCE, SEEN_BYTES = 256, 32 << 20
#: Vectors that are gathered at once, and distances in a table of walks.
GATHERED, DENSE = 4096, 1 << 22


def edges(vectors: DataFrame, degree: int = C.GRAPH_DEGREE, metric: str = "l2",
          **layout) -> DataFrame:
    """``(src, dst, distance)``: every row and its ``degree`` nearest earlier rows, both ways.

    Earlier means a smaller ``vec_id``. Exact at any size: all earlier rows are candidates, block
    by block.
    """
    asked = vectors.select(F.col("vec_id").alias("query_id"), "embedding")
    forward = knn(asked, vectors, degree, metric, earlier=True, **layout).select(
        F.col("query_id").alias("src"), F.col("vec_id").alias("dst"), "distance")
    return forward.unionByName(forward.select(
        F.col("dst").alias("src"), F.col("src").alias("dst"), "distance"))


def search(queries: DataFrame, vectors: DataFrame, links: DataFrame, k: int = 10,
           metric: str = "l2", beam: int = C.GRAPH_BEAM) -> DataFrame:
    """``(query_id, rank, vec_id, distance)`` by beam search from the row with the smallest id."""
    tagged = links.select(F.lit(metric).alias("metric"), "src", "dst")
    return search_many(queries, vectors, tagged, [metric], k, beam).drop("metric")


def search_many(queries: DataFrame, vectors: DataFrame, links: DataFrame, metrics: list[str],
                k: int = 10, beam: int = C.GRAPH_BEAM,
                shared_bytes: int = blocks.BROADCAST_BYTES) -> DataFrame:
    """Walks through one graph per metric, links(metric, src, dst).

    If vectors and links together are small (counted first), they are shared with every task and the
    queries walk to the end where they lie, some hundred together: one pass, nothing is shuffled.
    Otherwise the graph comes to some tasks as files (``_walk_in_rounds``), with the same result.
    """
    rows = shared_bytes // 64
    nodes, some = blocks.small_enough(vectors.select("vec_id", "embedding"), rows, shared_bytes)
    if some:
        steps, few = blocks.small_enough(links.select("metric", "src", "dst"), 4 * rows,
                                         4 * shared_bytes)
        if few and len(nodes):
            return _walk_shared(queries, nodes, steps, vectors.schema, metrics, k, beam)
    return _walk_in_rounds(queries, vectors, links, metrics, k, beam)


def _walk_shared(queries: DataFrame, nodes: pa.Table, steps: pa.Table, schema, metrics: list[str],
                 k: int, beam: int) -> DataFrame:
    nodes = nodes.combine_chunks().sort_by("vec_id")
    ids, vectors = blocks.values(nodes["vec_id"]), blocks.matrix(nodes["embedding"])
    source, target = (np.searchsorted(ids, blocks.values(steps[c])).astype(np.int32)
                      for c in ("src", "dst"))
    graphs = {}
    for metric in metrics:
        mine = np.flatnonzero(pa.compute.equal(steps["metric"], metric).to_numpy())
        order = mine[np.argsort(source[mine], kind="stable")]
        graphs[metric] = (np.searchsorted(source[order], np.arange(len(ids) + 1)), target[order])
    if _single(vectors):
        vectors = vectors.astype(np.float32)
    shared = queries.sparkSession.sparkContext.broadcast((ids, vectors, graphs))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, graphs = shared.value
        for batch in batches:
            asked, q = batch["query_id"], blocks.matrix(batch["embedding"])
            for metric, who, node, dist, rank in _answers(q, vectors, graphs, k, beam):
                yield pa.record_batch({
                    "metric": pa.array([metric] * len(who), pa.string()),
                    "query_id": asked.take(pa.array(who)), "rank": pa.array(rank),
                    "vec_id": pa.array(ids[node].tolist()), "distance": pa.array(dist)})

    kind = {f.name: f.dataType.simpleString() for f in queries.schema}
    id_kind = schema["vec_id"].dataType.simpleString()
    return spread(queries.select("query_id", "embedding"), "query_id").mapInArrow(
        scan, f"metric string, query_id {kind['query_id']}, rank int, vec_id {id_kind}, "
              "distance double")


def _single(vectors: np.ndarray) -> bool:
    """Whether single precision holds these numbers as they are, and sums of their squares."""
    with np.errstate(over="ignore", invalid="ignore"):
        return bool(((np.abs(vectors) < blocks.LARGEST) & (vectors.astype(np.float32) == vectors)).all())


def _answers(q: np.ndarray, vectors: np.ndarray, graphs: dict, k: int, beam: int) -> Iterator[tuple]:
    """``(metric, query, node, distance, rank)`` of the best ``k`` of each query, some walks at a time."""
    step = max(1, min(WALKS_AT_ONCE, SEEN_BYTES // len(vectors)))
    for start in range(0, len(q), step):
        for metric, (first, near) in graphs.items():
            who, node, dist = _walks(q[start: start + step], vectors, metric, first, near, beam)
            rank = _places(who)
            who, node, dist, rank = (c[rank < k] for c in (who, node, dist, rank))
            yield metric, start + who, node, dist, (rank + 1).astype(np.int32)


def _places(who: np.ndarray) -> np.ndarray:
    """The place of each row among those of the same, from 0; equal numbers lie together, in order."""
    return np.arange(len(who)) - np.searchsorted(who, who, "left")


def _spans(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin .. begin + count - 1 of every pair, one after the other."""
    return np.arange(count.sum()) + np.repeat(begin - np.cumsum(count) + count, count)


def _walks(q: np.ndarray, vectors: np.ndarray, metric: str, first: np.ndarray, near: np.ndarray,
           beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The beams of several queries after their walks, as (query, node, distance), best first. Links
    of node i are ``near[first[i]: first[i + 1]]``. Vectors in single precision hold their numbers
    exactly; then only what may enter a beam is measured in double."""
    def far(who: np.ndarray, node: np.ndarray) -> np.ndarray:
        out = np.empty(len(who))
        for i in range(0, len(who), GATHERED):
            cut = slice(i, i + GATHERED)
            out[cut] = row_distance(metric, q[who[cut]],
                                    vectors[node[cut]].astype(np.float64, copy=False), 0.0)
        return out

    n = len(vectors)
    between = _between(q, vectors, metric) if vectors.dtype == np.float32 and _single(q) else None
    who, node = np.arange(len(q)), np.zeros(len(q), np.int64)
    dist, new, place = far(who, node), np.ones(len(q), bool), np.zeros(len(q), np.int64)
    seen = np.zeros(len(q) * n, bool)
    seen[who * n] = True
    for _ in range(beam):
        begin, count = first[node[new]], first[node[new] + 1] - first[node[new]]
        reached = np.repeat(who[new], count) * n + near[_spans(begin, count)]
        reached = np.sort(reached[~seen[reached]])
        if not len(reached):
            break
        reached = reached[np.concatenate([[True], np.diff(reached) != 0])]
        seen[reached] = True
        by = reached // n
        to = reached - by * n
        if between is not None:
            low, high = between(by, to)
            fit = ~(low > _last_of(len(q), beam, (who, place, dist), (by, _places(by), high))[by])
            by, to = by[fit], to[fit]
        new = np.repeat([False, True], [len(who), len(to)])
        who, node = np.concatenate([who, by]), np.concatenate([node, to])
        dist = np.concatenate([dist, far(by, to)])
        best = np.lexsort((node, dist, who))
        place = _places(who[best])
        best, place = best[place < beam], place[place < beam]
        who, node, dist, new = who[best], node[best], dist[best], new[best]
    return who, node, dist


def _last_of(queries: int, beam: int, old: tuple, new: tuple) -> np.ndarray:
    """A distance that the last of each beam does not exceed: of those in it and, if that is no large
    table, of the upper bounds of new ones. All as (query, place, distance)."""
    most = int(new[1].max()) + 1
    if queries * (beam + most) > DENSE:
        most = 0
    table = np.full((queries, beam + most), np.inf)
    table[old[0], old[1]] = old[2]
    if most:
        table[new[0], beam + new[1]] = new[2]
    return np.partition(table, beam - 1, axis=1)[:, beam - 1]


def _between(q: np.ndarray, vectors: np.ndarray, metric: str) -> Callable:
    """Bounds of the distances of pairs (query, node), from single precision and its rounding."""
    single, unit = q.astype(np.float32), 2 * (q.shape[1] + 16) * blocks.ROUNDING
    lengths = np.sqrt((q * q).sum(axis=1))

    def some(by: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = single[by], vectors[to]
        if metric in ("l2", "manhattan"):
            np.subtract(x, y, out=x)
            near = (np.einsum("ij,ij->i", x, x) if metric == "l2"
                    else np.abs(x, out=x).sum(axis=1)).astype(np.float64)
            return near, near * unit + 1e-36
        near, inner = -np.einsum("ij,ij->i", x, y).astype(np.float64), np.einsum("ij,ij->i", y, y)
        known = (inner > 1e-30) & (lengths[by] > 1e-15)
        both = lengths[by] * np.sqrt(np.maximum(inner, 1e-30).astype(np.float64))
        if metric == "dot":
            return near, 2 * unit * both + 1e-36
        both = np.where(known, both, 1.0)
        return 1 + near / both, np.where(known, 4 * unit + 1e-36 / both, np.inf)

    def between(by: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near, off = np.empty(len(by)), np.empty(len(by))
        for i in range(0, len(by), GATHERED):
            cut = slice(i, i + GATHERED)
            near[cut], off[cut] = some(by[cut], to[cut])
        return near - off, near + off

    return between


def _walk_in_rounds(queries: DataFrame, vectors: DataFrame, links: DataFrame, metrics: list[str],
                    k: int, beam: int, part_rows: int = PART_ROWS) -> DataFrame:
    """Every task takes some queries and the whole graph, which it keeps in files of its own, not in
    memory; its queries walk to the end there, some together, in the same rounds.

    Nodes are numbered by id once; vectors and links travel packed, in rows of bounded size: a block of
    nodes with more than ``part_rows`` links becomes several. The graph is sent once to each task, and
    there are as many tasks as cores, more only if a task's queries would not fit. A task holds 24 bytes
    a node and its queries; files have no name and are gone with the task.
    """
    spark = queries.sparkSession
    numbered, total = _numbered(vectors)
    nodes = written(_packed_nodes(numbered, part_rows), "nodes")
    steps = _packed_links(numbered, links, metrics, part_rows)
    erase(numbered)
    # A repeated query is answered once per pair of its rows, one without an id not at all.
    asked = written(queries.join(queries.groupBy("query_id").agg(F.count(F.lit(1)).alias("copies")),
                                 "query_id").select("query_id", "copies", "embedding"), "asked")
    size = asked.agg(F.coalesce(F.sum(F.size("embedding") * 8), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // QUERY_BYTES))
    every = F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task")
    everything = asked.select(
        F.pmod(F.xxhash64("query_id", F.monotonically_increasing_id()), F.lit(tasks)).cast("int")
        .alias("task"), "query_id", "copies", "embedding").unionByName(
        nodes.select(every, "place", "ids", "vectors"), allowMissingColumns=True).unionByName(
        steps.select(every, "metric", "sources", "targets"), allowMissingColumns=True)
    single = vectors.schema["embedding"].dataType.elementType.typeName() == "float"
    kind = np.float32 if single else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, asked = _Files(total, kind), []
        for batch in batches:
            graph.add(batch.filter(batch["copies"].is_null()))
            mine = batch.filter(batch["copies"].is_valid())
            if len(mine):
                asked.append(mine.select(["query_id", "copies", "embedding"]))
        if not asked or not total:
            return
        ids, nodes, graphs = graph.whole(metrics)
        rows = pa.Table.from_batches(asked).combine_chunks()
        del asked
        copies, column = rows["copies"].to_numpy(), rows["query_id"].combine_chunks()
        for metric, who, node, dist, rank in _answers(
                blocks.matrix(rows["embedding"]), nodes, graphs, k, beam):
            out = np.repeat(np.arange(len(who)), copies[who])
            yield pa.record_batch({
                "metric": pa.array([metric] * len(out), pa.string()),
                "query_id": column.take(pa.array(who[out])), "rank": pa.array(rank[out]),
                "vec_id": ids.take(pa.array(node[out])), "distance": pa.array(dist[out])})

    kinds = [queries.schema["query_id"].dataType.simpleString(),
             vectors.schema["vec_id"].dataType.simpleString()]
    found = everything.repartitionById(tasks, F.col("task")).mapInArrow(
        run, f"metric string, query_id {kinds[0]}, rank int, vec_id {kinds[1]}, distance double")
    found = written(found, "walked")
    erase(nodes, steps, asked)
    return found


class _Files:
    """A graph in files without a name, filled by rows in any order, then read as mapped arrays."""

    def __init__(self, total: int, kind: type):
        self.total, self.kind, self.width = total, np.dtype(kind), None
        self.vectors, self.ids, self.steps, self.plain = tempfile.TemporaryFile(), {}, {}, True

    def add(self, batch: pa.RecordBatch) -> None:
        for row in range(len(batch)):
            place = batch["place"][row].as_py()
            if place is None:
                metric = batch["metric"][row].as_py()
                file, pieces = self.steps.setdefault(metric, (tempfile.TemporaryFile(), []))
                source, count = np.unique(np.frombuffer(batch["sources"][row].as_buffer(), np.int64),
                                          return_counts=True)
                pieces.append((source, count))
                file.write(batch["targets"][row].as_buffer())
                continue
            ids = batch["ids"][row].values
            some = np.frombuffer(batch["vectors"][row].as_buffer(), self.kind).reshape(len(ids), -1)
            if self.width not in (None, some.shape[1]):
                raise ValueError(f"vectors must be of one length: {self.width} and {some.shape[1]}")
            self.width, self.ids[place] = some.shape[1], ids
            self.plain = self.plain and _single(some)
            self.vectors.seek(place * self.width * self.kind.itemsize)
            self.vectors.write(some)

    def whole(self, metrics: list[str]) -> tuple[pa.Array, np.ndarray, dict]:
        """Ids and vectors by place, and the links of each metric by node."""
        self.vectors.flush()
        vectors = np.memmap(self.vectors, self.kind, "r", shape=(self.total, self.width))
        if not self.plain:
            vectors = vectors.astype(np.float64)
        ids = pa.concat_arrays([self.ids.pop(place) for place in sorted(self.ids)])
        return ids, vectors, {metric: self._links(metric) for metric in metrics}

    def _links(self, metric: str) -> tuple[np.ndarray, np.ndarray]:
        file, pieces = self.steps.pop(metric, (None, []))
        if not pieces:
            return np.zeros(self.total + 1, np.int64), np.empty(0, np.int64)
        source, count = (np.concatenate(c) for c in zip(*pieces))
        file.flush()
        mixed, begin = np.memmap(file, np.int64, "r"), np.cumsum(count) - count
        order, sorted_ = np.argsort(source, kind="stable"), tempfile.TemporaryFile()
        for i in range(0, len(order), PART_ROWS):
            some = order[i: i + PART_ROWS]
            sorted_.write(mixed[_spans(begin[some], count[some])])
        sorted_.flush()
        of = np.bincount(source, weights=count, minlength=self.total).astype(np.int64)
        return np.concatenate([[0], np.cumsum(of)]), np.memmap(sorted_, np.int64, "r")


def _numbered(vectors: DataFrame) -> tuple[DataFrame, int]:
    """Vectors with their ``place`` in the order of their ids, from 0, and how many there are."""
    bits = 33
    sorted_ = written(vectors.select("vec_id", "embedding").dropDuplicates(["vec_id"]).orderBy("vec_id")
                      .withColumn("place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("place", bits)
    sizes = dict(sorted_.groupBy(part.cast("int")).count().toArrow().to_pandas().values.tolist())
    counts = [sizes.get(i, 0) for i in range(max(sizes, default=0) + 1)]
    before = F.array(*[F.lit(int(n)).cast("bigint") for n in np.cumsum([0, *counts[:-1]])])
    place = F.get(before, part.cast("int")) + F.col("place").bitwiseAND(F.lit((1 << bits) - 1))
    out = sorted_.withColumn("place", place)
    out.written_to = sorted_.written_to
    return out, sum(counts)


def _packed_nodes(numbered: DataFrame, part_rows: int) -> DataFrame:
    """A row per block of nodes: its first place, the ids and the vectors of its nodes."""
    kinds = {f.name: f.dataType for f in numbered.schema}
    single = kinds["embedding"].elementType.typeName() == "float"
    id_kind = kinds["vec_id"].simpleString()

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place").combine_chunks()
        x = blocks.matrix(rows["embedding"]).astype(np.float32 if single else np.float64)
        return pa.table({"place": rows["place"].slice(0, 1),
                         "ids": pa.array([rows["vec_id"].to_pylist()], pa.list_(rows["vec_id"].type)),
                         "vectors": pa.array([x.tobytes()], pa.binary())})

    block = F.floor(F.col("place") / max(1, part_rows // 16)).alias("block")
    return numbered.select("place", "vec_id", "embedding", block).groupBy("block").applyInArrow(
        pack, f"place bigint, ids array<{id_kind}>, vectors binary")


def _packed_links(numbered: DataFrame, links: DataFrame, metrics: list[str],
                  part_rows: int) -> DataFrame:
    """Rows of about ``part_rows`` links of neighbouring nodes at most, as places, sorted by source."""
    where = [numbered.select(F.col("vec_id").alias(c), F.col("place").alias(to))
             for c, to in (("src", "source"), ("dst", "target"))]
    steps = written(links.filter(F.col("metric").isin(metrics)).select("metric", "src", "dst").join(
        where[0], "src").join(where[1], "dst").select("metric", "source", "target", F.floor(
            F.col("source") / max(1, part_rows // 16)).alias("block")), "placed")
    sizes = written(steps.groupBy("metric", "block").agg(
        F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("parts")).filter("parts > 1"), "sizes")
    few = sizes.count() <= FEW_BLOCKS
    part = F.pmod(F.xxhash64("target"), F.coalesce("parts", F.lit(1))).alias("part")

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("source")
        return pa.table({"metric": rows["metric"].slice(0, 1), **{
            f"{c}s": pa.array([rows[c].to_numpy().tobytes()], pa.binary())
            for c in ("source", "target")}})

    packed = written(steps.join(F.broadcast(sizes) if few else sizes, ["metric", "block"], "left").select(
        "metric", "source", "target", "block", part).groupBy("metric", "block", "part").applyInArrow(
        pack, "metric string, sources binary, targets binary"), "steps")
    erase(steps, sizes)
    return packed
