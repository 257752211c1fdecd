import zlib
from collections import Counter

import pytest
from helpers import awkward, docs

from quillon.llm import numbering, sharding
from quillon.llm.queries import QUERIES


def check(got, rows, shards=8):
    """Every row once, right sizes and checksums, counts at most one apart, gapless slots."""
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
                   for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert {r["law"] for r in got} <= {"rows"}
    counts = Counter(r["shard"] for r in got)
    full = [counts.get(s, 0) for s in range(shards)]
    assert sum(full) == len(rows) and max(full) - min(full) <= 1
    for s in range(shards):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(full[s]))


def split_groups(got, rows):
    """Links of equal texts that stay within a shard, and all such links."""
    texts = {}
    for i, t in rows:
        texts[i] = t
    groups = {}
    for r in got:
        groups.setdefault(texts[r["doc_id"]], []).append(r["shard"])
    kept = sum(n * (n - 1) // 2 for g in groups.values() for n in Counter(g).values())
    return kept, sum(len(g) * (len(g) - 1) // 2 for g in groups.values())


def test_groups_stay_together(spark, monkeypatch):
    monkeypatch.setattr(numbering, "SLICE_ROWS", 50)
    rows = [(i, f"text {i}") for i in range(500)]
    rows += [(1000 + i, f"copy {i % 30}") for i in range(180)]
    got = sharding.shard(docs(spark, rows, row=1, same="x", shard=3, size=0)).collect()
    check(got, rows)
    kept, links = split_groups(got, rows)
    assert kept > 0.85 * links


@pytest.mark.parametrize("single, twins, least", [(4000, 400, 1.0), (0, 2000, 0.98)])
def test_twins_come_together(spark, single, twins, least):
    rows = [(i, f"text {i}") for i in range(single)]
    rows += [(10_000 + i, f"twin {i % twins}") for i in range(2 * twins)]
    got = sharding.shard(docs(spark, rows)).collect()
    check(got, rows)
    kept, links = split_groups(got, rows)
    assert kept >= least * links


def test_a_group_of_a_third(spark):
    rows = [(i, f"t {i}") for i in range(400)] + [(1000 + i, "hot") for i in range(200)]
    got = sharding.shard(docs(spark, rows)).collect()
    check(got, rows)
    kept, links = split_groups(got, rows)
    assert kept > 2 * links / 8


def test_awkward_rows(spark):
    rows = awkward()
    check(sharding.shard(docs(spark, rows, edge=1, to=2, gain=3)).collect(), rows)
    assert sharding.shard(docs(spark, [])).count() == 0
    check(sharding.shard(docs(spark, [(1, "a")])).collect(), [(1, "a")])


@pytest.mark.parametrize("shards", [2, 5])
def test_given_links(spark, shards):
    from quillon.session import written

    nodes = written(spark.range(400).withColumnRenamed("id", "row"), "nodes")
    pairs = [(i, i + 1) for i in range(0, 400, 2)] + [(i, i + 2) for i in range(0, 396, 4)]
    ends = [(row, edge) for edge, pair in enumerate(pairs) for row in pair]
    links = spark.createDataFrame(ends, "row long, edge long")
    got = {r["row"]: r["shard"] for r in sharding.propagate(nodes, links, shards, 16).collect()}
    assert max(Counter(got.values()).values()) - min(Counter(got.values()).values()) <= 1
    cut = sum(got[a] != got[b] for a, b in pairs)
    assert cut < 0.75 * len(pairs) * (1 - 1 / shards)


def test_query_on_its_table(spark, sf):
    rows = [(r["doc_id"], r["text"])
            for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(QUERIES["op4_label_propagation"](spark, sf).collect(), rows)


def test_numbers_are_gapless(spark, monkeypatch):
    from pyspark.sql import functions as F

    from quillon.session import written

    monkeypatch.setattr(numbering, "SLICE_ROWS", 7)
    frame = written(spark.range(300).select("id", (F.col("id") % 3).alias("g")), "n")
    rows = numbering.numbered(frame, "g", [F.col("id")], F.pmod(F.xxhash64("id"), F.lit(100)) / 100.0,
                              "k", 300).collect()
    for g in range(3):
        assert sorted(r["k"] for r in rows if r["g"] == g) == list(range(100))


def test_large_edges_move_as_a_whole(spark, monkeypatch):
    """Two edges of 1,200 in one of two shards: one stays, the other goes, none is split."""
    from pyspark.sql import functions as F

    from quillon.session import written

    monkeypatch.setattr(numbering, "SLICE_ROWS", 100)
    monkeypatch.setattr(sharding, "SLICE_ROWS", 100)
    links = spark.range(2400).select(F.col("id").alias("row"), F.floor(F.col("id") / 1200).alias(
        "edge"))
    now = written(links.join(sharding._spots(links), "row").select(
        "row", F.lit(True).alias("linked"), "spot", F.lit(0).alias("shard")), "now")
    got = sharding._even(now, 2, 2400).collect()
    homes = {e: {r["shard"] for r in got if r["row"] // 1200 == e} for e in (0, 1)}
    assert sorted(map(sorted, homes.values())) == [[0], [1]]


def test_spots_lay_edges_end_to_end(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLICE_ROWS", 50)
    ends = [(i, i % 7 if i < 300 else i // 2) for i in range(600)] + [(5, 900), (299, 900)]
    spots = {r["row"]: r["spot"] for r in sharding._spots(
        spark.createDataFrame(ends, "row long, edge long")).collect()}
    least = {}
    for row, edge in ends:
        least[row] = min(edge, least.get(row, edge))
    assert spots.keys() == least.keys() and all(0 <= s < 0.5 for s in spots.values())
    order = [least[r] for r in sorted(spots, key=spots.get)]
    assert sum(a != b for a, b in zip(order, order[1:])) == len(set(order)) - 1
    in_half = sum(s < 0.25 for s in spots.values())
    assert abs(in_half - len(spots) / 2) < 60


@pytest.mark.parametrize("full, thin", [([], False), ([1], False), ([], True)])
def test_a_round_against_a_plain_twin(spark, full, thin):
    """Wishes by counting every neighbour, grants by walking through the steps of each pair."""
    import random

    rng = random.Random(4)
    shard_of = {i: rng.randrange(4) for i in range(160)}
    ends = sorted({(rng.randrange(160), rng.randrange(45)) for _ in range(260)})
    now = spark.createDataFrame(list(shard_of.items()), "row long, shard int")
    links = spark.createDataFrame(ends, "row long, edge long")
    salt = 3

    def chance(number, values, column):
        df = spark.createDataFrame([(v,) for v in values], f"{column} long")
        return {r[0]: r[1] for r in df.select(column, sharding._chance(number, column)).collect()}

    coin = {e: c < 0.5 for e, c in chance(100 + salt, range(45), "edge").items()}
    rest = chance(200 + salt, range(160), "row")
    want = {}
    for row in range(160):
        votes, least = Counter(), {}
        for e in (e for r, e in ends if r == row):
            for other in {r for r, x in ends if x == e}:
                there = shard_of[other]
                votes[there] += other != row
                least[there] = min(e, least.get(there, e))
        open_ = [(n, -s) for s, n in votes.items() if s != shard_of[row] and s not in full]
        if open_:
            n, minus = max(open_)
            gain, to = n - votes[shard_of[row]], -minus
            if (gain > 1 or gain == 1 and coin[least[to]] == (to > shard_of[row])) and not (
                    thin and rest[row] >= 0.5):
                want[row] = (to, gain)
    wishes = sharding._wishes(now, links, full, salt, thin)
    assert {r["row"]: (r["to"], r["gain"]) for r in wishes.collect()} == want and len(want) > 5

    free = {0: 2, 1: 0, 2: 5, 3: 1}
    place = chance(salt, range(160), "row")
    steps = {}
    for row, (to, gain) in want.items():
        step = (31 - min(31, gain.bit_length() - 1)) * sharding.STEPS + int(
            place[row] * sharding.STEPS)
        steps.setdefault((shard_of[row], to), {}).setdefault(step, []).append(row)
    granted = {}
    for (a, b), by_step in steps.items():
        quota = sum(map(len, steps.get((b, a), {}).values())) + max(0, free[b]) // sum(
            t == b for _, t in steps)
        for step in sorted(by_step):
            if len(by_step[step]) > quota:
                break
            quota -= len(by_step[step])
            granted |= dict.fromkeys(by_step[step], b)
    got = sharding._granted(wishes, free, salt)
    assert {r["row"]: r["moved"] for r in got.collect()} == granted
