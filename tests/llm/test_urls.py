import random
import sys

import duckdb
import pandas as pd
import pytest

from quillon.llm import urls
from quillon.llm.oracles import ORACLES
from quillon.llm.queries import QUERIES

sys.path.insert(0, "tests")
from compare import compare, connect  # noqa: E402


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, host string, rule int, n int")


def against_oracle(spark, rows):
    con = duckdb.connect()
    con.register("pages", pd.DataFrame({"page_id": pd.Series([r[0] for r in rows], dtype="Int64"),
                                        "url": pd.Series([r[1] for r in rows], dtype="string")}))
    frame = pages(spark, [(*r, "x", 1, 2) for r in rows])
    assert compare(urls.judge(frame), con, ORACLES["op2_path_templates"]) is None


def test_parts_and_rules(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "HTTP://A.Example.ORG/es/x?q#f"),
            (5, "x://example.org/en/12"), (6, "x://example.org"), (7, "x://org/"),
            (8, "x://notorg/fr/"), (9, "x://a.com/fr/1"), (10, "x://a.com/de/1#/z"),
            (11, "x://a.com?p=/de/"), (12, "a://b://c/d"), (13, "://h//a//b"), (None, "x://org/a"),
            (14, "x://ÄÖ.com/de/é"), (14, "x://ÄÖ.com/de/é"), (15, "x://a.example.org/en/")]
    got = {r["page_id"]: r for r in urls.judge(pages(spark, [(*r, "x", 1, 2) for r in rows]))
           .collect()}
    assert [got[k]["host"] for k in (1, 2, 3, 4, 12, 14)] == [
        "", "", "", "a.example.org", "b:", "ÄÖ.com"]
    assert [got[k]["path"] for k in (1, 4, 6, 10, 11, 12, 13)] == [
        "", "/es/x", "", "/de/1", "", "//c/d", "//a//b"]
    assert [got[k]["rule"] for k in (4, 5, 6, 7, 8, 9, 10, 11, None, 14, 15)] == [
        "example.org/es/", "example.org/en/1", None, "org/", None, "com/fr/", "com/de/", None,
        "org/", "com/de/", "org/"]
    assert got[10]["verdict"] == "block" and got[9]["verdict"] == "allow"
    against_oracle(spark, rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_trees(spark, seed):
    rng = random.Random(seed)
    hosts = ["a.com", "b.com", "example.org", "x.net", "y.net", "c.com"]
    rows = []
    for i in range(1500):
        host = rng.choice(hosts[: rng.randint(1, 6)])
        parts = [rng.choice(["de", "fr", "es", "en", "blog", f"slug-{chr(97 + i % 26)}{i}"])]
        word = "".join(rng.choices("abcdefgh", k=9))
        parts += [rng.choice(["p", str(i), f"{i}.html", word, word, word]) for _ in range(rng.randint(0, 5))]
        rows.append((i, f"http://{host}/" + "/".join(parts) + rng.choice(["", "/", "?q=1", "#t"])))
    against_oracle(spark, rows)
    kinds = {r["template"] for r in urls.judge(pages(spark, [(*r, "x", 1, 2) for r in rows]))
             .collect()}
    assert any("*" in k for k in kinds) and any("~" in k for k in kinds)


def test_block_heavy_template_is_rejected(spark):
    rows = [(i, f"x://s.com/de/{i}") for i in range(60)]
    rows += [(100 + i, f"x://s.com/fr/{i}") for i in range(60)]
    rows += [(900, "x://s.com/de"), (901, "x://s.com/fr"), (902, "x://s.com/it/1")]
    got = {r["page_id"]: r for r in urls.judge(pages(spark, [(*r, "x", 1, 2) for r in rows]))
           .collect()}
    assert got[900]["rule"] is None and got[900]["verdict"] == "block"
    assert got[901]["rule"] is None and got[901]["verdict"] == "allow"


def test_no_rows(spark):
    assert urls.judge(pages(spark, [])).count() == 0


def test_query_equals_its_statement(spark):
    sf = "/root/testdata/sf0.01"
    df = QUERIES["op2_path_templates"](spark, sf)
    assert compare(df, connect(sf), ORACLES["op2_path_templates"]) is None


def test_deep_segments_vary_too(spark):
    rows = [(i, f"x://s.com/a/b/c/d/e/v{chr(97 + i)}x/end") for i in range(20)]
    frame = pages(spark, [(*r, "x", 1, 2) for r in rows])
    shapes = urls.judge(frame).select("template").distinct().collect()
    assert len(shapes) == 1
    against_oracle(spark, rows)


def test_merged_siblings_pool_their_children(spark):
    """Under each of six siblings there is one blocked child: too few alone, enough together."""
    rows = [(i, f"x://a.com/fr/{i}") for i in range(40)] + [
        (100 + i, f"x://b.com/de/{i}") for i in range(40)]
    rows += [(200 + i, f"x://sub.example.org/{w}/bad/x") for i, w in enumerate(["u", "v", "w", "y"] * 4)]
    rows += [(300 + i, f"x://q.com/{w}/fr/1") for i, w in enumerate(["k", "l", "m"] * 3)]
    rows += [(400 + i, f"x://com/de/{w}/bad/{i}") for i, w in enumerate("nopqrs")]
    against_oracle(spark, rows)
    made = spark.createDataFrame(
        [("h", f"{w}/{c}", [w, c], 1 if c == "ok" else 0, 1 if c == "bad" else 0)
         for w in "klmnop" for c in ("ok", "bad")],
        "host string, shape string, general array<string>, allowed int, blocked int")
    out = {r["shape"]: r for r in urls._judged_shapes(made, 2, 4.0, 0.5).collect()}
    assert {out[f"{w}/bad"]["template"] for w in "klmnop"} == {"h/~/bad"}
    assert out["k/bad"]["purity"] > 0.75 and out["k/ok"]["purity"] < 0.25


def test_a_page_does_not_depend_on_how_deep_others_are(spark):
    rows = [(i, f"x://a.com/{'fr' if i % 3 else 'de'}/{i}") for i in range(30)] + [(50, "x://a.com/x")]
    alone = {r["page_id"]: (r["template"], r["purity"]) for r in urls.judge(
        pages(spark, [(*r, "x", 1, 2) for r in rows])).collect()}
    deep = rows + [(99, "x://nolabels.net/" + "/".join("abcdefgh"))]
    among = {r["page_id"]: (r["template"], r["purity"]) for r in urls.judge(
        pages(spark, [(*r, "x", 1, 2) for r in deep])).collect()}
    assert {k: v for k, v in among.items() if k != 99} == alone
