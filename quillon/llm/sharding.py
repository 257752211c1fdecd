"""Shards of linked documents by balanced label propagation.

Every document starts in a shard chosen by a hash. In each round a join of the links with the
present shards counts every document's neighbours per shard; a document wants the shard with most of
them, if it is not its own. Moves between two shards are granted up to a quota: what the target is short of, plus as many
as want to go the other way. Who goes first is decided by gain and a hash, through counts per gain
class and hash step, so neither a shard's nor a hot document's rows are collected. A gain of 1 is mutual
(the other document would gain by coming here), so a hash of the edge decides which way it goes. Rounds
that keep more links than before count; it ends when ``IDLE`` in a row did not, at least half of them
with swaps between full shards. Then surplus documents, unlinked ones first and linked ones edge by
edge, fill what is missing, and counts are at most one apart (law ``rows``). All edges, small or large,
lie side by side in one order, so one is split only where the cut between two shards falls in it.

Links are given as a table of edges, or are those of equal texts. An edge may have any number of
members: its members are counted per shard, never paired.

Defined cases: a null text is empty (size 1), all empty texts are equal; repeated rows are documents
of their own; null ids are allowed; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.numbering import SLICE_ROWS, numbered
from quillon.session import erase, written

SHARDS, IDLE, STEPS = 8, 4, 256


def _chance(salt: int, *columns: str) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(F.lit(salt), *columns), F.lit(1 << 30)) / float(1 << 30)


def _wishes(now: DataFrame, links: DataFrame, full: list[int], salt: int, thin: bool) -> DataFrame:
    """row, shard, to, gain of every document with more neighbours in another shard that has room.

    An edge's members are counted per shard once, whatever their number; each member then sees the
    counts of its edges, less itself. ``thin`` leaves half of the wishes out, by a hash.
    """
    held = links.join(now.select("row", "shard"), "row")
    counts = held.groupBy("edge", "shard").agg(F.count(F.lit(1)).alias("n")).select(
        "edge", F.col("shard").alias("there"), "n")
    own = F.when(F.col("shard") == F.col("there"), 1).otherwise(0)
    votes = held.join(counts, "edge").groupBy("row", "shard", "there").agg(
        F.sum(F.col("n") - own).alias("votes"), F.min("edge").alias("edge"))
    here = F.col("shard") == F.col("there")
    open_ = ~here & ~F.col("there").isin(full) if full else ~here
    best = votes.groupBy("row", "shard").agg(
        F.max(F.when(open_, F.struct("votes", (-F.col("there")).alias("minus"),
                                           "edge"))).alias("best"),
        F.coalesce(F.max(F.when(here, F.col("votes"))), F.lit(0)).alias("here"))
    upward = _chance(100 + salt, "best.edge") < 0.5
    wishes = best.withColumns({
        "to": -F.col("best.minus"), "gain": F.col("best.votes") - F.col("here")}).filter(
        (F.col("gain") > 1) | (F.col("gain") == 1) & (upward == (F.col("to") > F.col("shard"))))
    if thin:
        wishes = wishes.filter(_chance(200 + salt, "row") < 0.5)
    return wishes.select("row", "shard", "to", "gain")


def _kept(now: DataFrame, links: DataFrame) -> int:
    """Links within shards, twice."""
    n = F.count(F.lit(1)).cast("decimal(18,0)")
    return int(links.join(now.select("row", "shard"), "row").groupBy("edge", "shard").agg(
        (n * (n - 1).cast("decimal(18,0)")).alias("n")).agg(F.sum("n")).first()[0] or 0)


def _room(now: DataFrame, shards: int, total: int) -> dict[int, int]:
    """How many linked rows each shard still takes: its fair share less what it has. Unlinked rows
    give way at the end."""
    sizes = {r["shard"]: r["count"]
             for r in now.filter("linked").groupBy("shard").count().collect()}
    return {s: total // shards - sizes.get(s, 0) for s in range(shards)}


def _granted(wishes: DataFrame, free: dict[int, int], salt: int) -> DataFrame:
    """The wishes within quota, whole steps of (gain class, hash) at a time."""
    gain_class = F.least(F.floor(F.log2(F.col("gain"))), F.lit(31)).cast("int")
    ranked = wishes.withColumn("step", (31 - gain_class) * STEPS + F.floor(
        _chance(salt, "row") * STEPS).cast("int"))
    demand: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r in ranked.groupBy("shard", "to", "step").count().collect():  # bounded by shards and steps
        demand.setdefault((r["shard"], r["to"]), []).append((r["step"], r["count"]))
    limits = []
    for (a, b), steps in sorted(demand.items()):
        back = sum(n for _, n in demand.get((b, a), []))
        quota, last = back + max(0, free[b]) // sum(t == b for _, t in demand), -1
        for step, n in sorted(steps):
            if n > quota:
                break
            quota, last = quota - n, step
        limits.append((a, b, last))
    cut = wishes.sparkSession.createDataFrame(limits, "shard int, to int, last int")
    return ranked.join(F.broadcast(cut), ["shard", "to"]).filter("step <= last").select(
        "row", F.col("to").alias("moved"))


def _even(now: DataFrame, shards: int, rows: int) -> DataFrame:
    """Counts at most one apart: surplus rows, unlinked ones first, fill the shards that lack."""
    placed = written(numbered(now, "shard", [F.col("spot"), F.col("row")], F.col("spot"), "place",
                              rows), "shard-places")
    sizes = {r["shard"]: r["count"] for r in placed.groupBy("shard").count().collect()}
    fair = {s: rows // shards + (s < rows % shards) for s in range(shards)}
    over = [(s, fair[s]) for s in range(shards) if sizes.get(s, 0) > fair[s]]
    bounds = now.sparkSession.createDataFrame(over, "shard int, fair long")
    surplus = written(placed.join(F.broadcast(bounds), "shard").filter("place >= fair").select(
        "row", "spot", F.lit(0).alias("all")), "shard-surplus")
    number = numbered(surplus, "all", [F.col("spot"), F.col("row")], F.col("spot"), "number",
                      surplus.count())
    home, at = F.lit(None).cast("int"), 0
    for s in range(shards):
        missing = max(0, fair[s] - sizes.get(s, 0))
        inside = (F.col("number") >= at) & (F.col("number") < at + missing)
        home, at = F.when(inside, F.lit(s)).otherwise(home), at + missing
    moved = number.select("row", home.alias("moved"))
    out = written(placed.drop("place", "spot").join(moved, "row", "left").withColumn(
        "shard", F.coalesce("moved", "shard")).drop("moved"), "shard-even")
    erase(placed, surplus)
    return out


def _spots(links: DataFrame) -> DataFrame:
    """(row, spot): linked rows in 0 .. 0.5, those of an edge side by side, edges ordered by a hash.

    A row counts for its least edge. Edges are laid end to end by running sums within hash steps of
    about ``SLICE_ROWS`` rows and the steps' totals, so spots are even whatever the edges' sizes.
    """
    ends = links.groupBy("row").agg(F.min("edge").alias("least"))
    edges = written(ends.groupBy("least").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "hash", _chance(3, "least")), "shard-edges")
    total = edges.agg(F.sum("n")).first()[0] or 1
    steps = max(1, total // SLICE_ROWS)
    stepped = edges.withColumn("step", F.floor(F.col("hash") * steps))
    upto = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)  # a row per step
    before = stepped.groupBy("step").agg(F.sum("n").alias("held")).select(
        "step", F.coalesce(F.sum("held").over(upto), F.lit(0)).alias("before"))
    inside = Window.partitionBy("step").orderBy("hash", "least").rowsBetween(
        Window.unboundedPreceding, -1)
    first = stepped.withColumn("first", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(
        before, "step").select("least", "n", (F.col("first") + F.col("before")).alias("first"))
    return ends.join(first, "least").select("row", (
        (F.col("first") + _chance(4, "row") * F.col("n")) / (2.0 * total)).alias("spot"))


def propagate(nodes: DataFrame, links: DataFrame, shards: int = SHARDS,
              rounds: int | None = None) -> DataFrame:
    """``nodes`` (a column ``row``, unique; fixed) with columns ``linked`` and ``shard``.

    ``links``: row, edge. All rows of an edge are neighbours of each other; a plain link is an edge
    of two rows. ``rounds``, if given, is the most that are run.
    """
    start = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    now = written(nodes.join(_spots(links), "row", "left").select(
        *nodes.columns, F.col("spot").isNotNull().alias("linked"),
        F.coalesce("spot", 0.5 + _chance(0, "row") / 2).alias("spot"), start.alias("shard")),
        "shards")
    rows = now.count()
    best, idle, k, thin = _kept(now, links), 0, 0, False
    while rows and idle < IDLE and (rounds is None or k < rounds):
        free = _room(now, shards, rows)
        nearly = max(shards, rows // shards // 50)
        full = [s for s, n in free.items() if n < nearly] if k % 2 == 0 else []
        full = [] if len(full) == shards else full  # swaps in odd rounds, and where nothing else moves
        wishes = written(_wishes(now, links, full, k, thin), "shard-wishes")
        moves = written(_granted(wishes, free, k), "shard-moves")
        some, better = bool(moves.take(1)), False
        if some:
            after = written(now.join(moves, "row", "left").withColumn(
                "shard", F.coalesce("moved", "shard")).drop("moved"), "shards")
            kept = _kept(after, links)
            better = kept > best
            if better:
                now, after, best = after, now, kept
            erase(after)
        erase(wishes, moves)
        thin = some and not better
        idle = 0 if better else idle + 1
        k += 1
    return _even(now, shards, rows) if rows else now.drop("spot")


def equal_text_links(nodes: DataFrame) -> DataFrame:
    """An edge for every group of rows with equal ``same``."""
    groups = nodes.groupBy("same").agg(F.min("row").alias("edge"), F.count(F.lit(1)).alias("n"))
    return nodes.select("row", "same").join(groups.filter("n > 1"), "same").select("row", "edge")


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for every row."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    nodes = written(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long")
        .alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("same"))
        .withColumn("row", F.monotonically_increasing_id()), "shard-nodes")
    links = written(equal_text_links(nodes), "shard-links")
    placed = propagate(nodes.drop("same"), links, shards, rounds)
    out = numbered(placed, "shard", [F.col("row")], _chance(2, "row"), "slot", placed.count())
    erase(links)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
