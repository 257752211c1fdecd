import hashlib
import random
import re
import sys
import time

import duckdb
import pandas as pd
import pytest
from helpers import awkward, docs

from quillon.llm import personal as P
from quillon.llm.oracles import ORACLES
from quillon.llm.queries import QUERIES

sys.path.insert(0, "tests")
from compare import compare, connect  # noqa: E402

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def doubled(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base(text):
    found = []
    for order, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip"
                else None, "card": 12 <= len(digits) <= 19 and doubled(digits),
                    "phone": 9 <= len(digits) <= 15}[kind]:
                found.append((m.start(), order, kind, m.end()))
    return sorted(found)


FACTS = ["a.b@c.de", "é@x.y.z", "x@y", "10.0.0.1", "256.1.1.1", "0001.002.3.4.5", "4111111111111111",
         "4111-1111 1111 1111", "4111 1111 1111 1112", "+1 (555) 555-1234", "+49 30 1234567",
         "+1234", "DE89370400440532013000", "DE89 3704 0044 0532 0130 00",
         "GB82 WEST 1234 5698 7654 32", "GB83WEST12345698765432", "123-45-6789", "666-45-6789",
         "021000021", "021000022", "IBAN", "ssn", "Routing", "card", "version", "Größe", "東京", "\n",
         "@", "+", ".", "-", "12", "a_b", "order"]


def made(n=400, seed=5):
    rng = random.Random(seed)
    return [(i, "".join(rng.choice(FACTS) + rng.choice([" ", "", ",", "  ", ". "])
                        for _ in range(rng.randint(0, 14)))) for i in range(n)]


def listed(found):
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in found)


def test_base_kinds_are_what_the_plain_patterns_find(spark):
    rows = made() + awkward()
    got = P.report(docs(spark, rows, spans="x", n_ip=1, kind="y")).collect()
    assert len(got) == len(rows)
    want = sorted((str((i, *(sum(f[2] == k for f in base(t or "")) for k in PLAIN),
                        hashlib.sha256(listed(base(t or "")).encode()).hexdigest()))
                   for i, t in rows))
    assert sorted(str(tuple(r)[:6]) for r in got) == want
    for r in got:
        kinds = [s.split(":")[0] for s in r["spans"].split(",") if s]
        assert [kinds.count(k) for k in PLAIN] == list(r)[1:5]
        assert len(r["scores"].split(",")) == len(r["spans"].split(","))
    assert P.report(docs(spark, [])).count() == 0


@pytest.mark.parametrize("text, kinds", [
    ("Pay to IBAN DE89 3704 0044 0532 0130 00.", ["iban"]),
    ("Pay to IBAN DE88 3704 0044 0532 0130 00.", []),
    ("Code GB82WEST12345698765432 AND more", ["iban"]),
    ("serial GB82WEST12345698765432", ["iban"]),
    ("ssn: 123-45-6789", ["ssn"]), ("ssn 666-45-6789", []), ("number 123-45-6789", []),
    ("ssn or part 123-45-6789", []),
    ("routing 021000021", ["aba"]), ("routing 021000022", []), ("021000021", []),
    ("The routing" + " x" * 30 + " 021000021", []),
])
def test_checksums_and_context_decide_the_other_kinds(text, kinds):
    assert [s.kind for s in P.spans(text)] == kinds


def test_context_moves_the_score_of_base_kinds():
    alone, near, against = (P.spans(t)[0].tenths for t in (
        "see 10.0.0.1", "server 10.0.0.1", "version 10.0.0.1"))
    assert (alone, near, against) == (6, 10, 3)


def test_checksums():
    rng = random.Random(1)
    for _ in range(300):
        digits = "".join(rng.choices("0123456789", k=rng.randint(12, 19)))
        assert P.luhn(digits) == doubled(digits)
    assert P.mod97("GB82WEST12345698765432") and not P.mod97("GB28WEST12345698765432")


@pytest.mark.parametrize("part", ["a", "1", "1.", "+1", "+1((", "a@", "@a.", "9-", "AB12 ", "1-2-",
                                  "a@b.", "é", "AA11"])
def test_hostile_long_texts_take_linear_time(part):
    began = time.time()
    P.spans(part * (1_000_000 // len(part)))
    assert time.time() - began < 20


def test_masking_keeps_the_rest(spark):
    rows = [(1, "Mail a@b.co or call +1 (555) 555-1234 now"), (2, None), (3, "clean"),
            (None, "card 4111 1111 1111 1111")]
    df = docs(spark, rows, kind="x")
    got = P.mask(df)
    assert got.columns == df.columns
    assert {(r["doc_id"], r["text"]) for r in got.collect()} == {
        (1, "Mail [EMAIL] or call [PHONE] now"), (2, None), (3, "clean"), (None, "card [CARD]")}
    assert all(r["kind"] == "x" for r in got.collect())


def test_finds_as_structs(spark):
    found = P.find(docs(spark, [(7, "host 10.0.0.1, ssn 123-45-6789")])).first()["found"]
    assert [(f["kind"], f["start"], f["end"], f["score"], f["base"]) for f in found] == [
        ("ip", 5, 13, 1.0, True), ("ssn", 19, 30, 0.7, False)]


def test_statement_on_made_rows(spark):
    rows = [r for r in made() if r[1]]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    assert compare(P.report(docs(spark, rows)), con, ORACLES["op12_checked_spans"]) is None


def test_query_equals_its_statement(spark):
    sf = "/root/testdata/sf0.01"
    assert compare(QUERIES["op12_checked_spans"](spark, sf), connect(sf),
                   ORACLES["op12_checked_spans"]) is None
