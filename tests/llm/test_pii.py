import hashlib
import re

import pytest

from defectlens.llm import pii
from defectlens.llm.queries import registered

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain(text):
    out = {}
    for kind, rule in RULES.items():
        spans = []
        for m in re.finditer(rule, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            spans.append(f"{kind}:{m.start()}:{m.end()}")
        out[kind] = spans
    return out


CASES = [
    None, "", "nothing here", "a@b.c+d@e.f g@h", "x..y@mail-1.example.com.", "über@ex.com é@b.co",
    "1.2.3.4.5.6.7.8 01.002.3.4 300.1.1.1 1.2.3", "ip 10.0.0.1-10.0.0.2", "4041894974608795 4041 8949-7460 8795",
    "4041  8949", "+1 (988) 555-2485, +49 30 1234567 and +1 2", "+1      ", "9" * 6000, "a" * 50000, "1.1." * 3000,
    "😀 4041894974608795 😀 a@b.de", "+12345678901234567890", "@@a@b@c.d", "a@b.c.d..e@f.g", "12345678901234567890.1.1.1",
    "iban DE89 3704 0044 0532 0130 00 ok", "tel 030 1234567", "lot 030 1234567", "0" * 16,
    "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 1.2.3.4", "a+b@c.d\n+4 5@6.7",
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, t, "other") for i, t in enumerate(CASES + CASES[3:5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, emails string")
    return {r["doc_id"]: r for r in pii.find_spans(docs).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_base_spans(found, i):
    want = plain(CASES[i])
    for kind in pii.BASE:
        got = [f"{kind}:{s['start']}:{s['end']}" for s in found[i][f"{kind}s"]]
        assert got == want[kind], kind


def test_repeated_rows_are_equal(found):
    assert found[len(CASES)]["emails"] == found[3]["emails"]


def test_checksum_and_context(found):
    assert [s["found"] for s in found[CASES.index("iban DE89 3704 0044 0532 0130 00 ok")]["ibans"]] == \
        ["DE89 3704 0044 0532 0130 00"]
    assert len(found[CASES.index("tel 030 1234567")]["numbers"]) == 1
    assert len(found[CASES.index("lot 030 1234567")]["numbers"]) == 0


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "mail a@b.de or 10.0.0.1"), (2, None)], "doc_id long, text string")
    assert {r[0]: r[1] for r in pii.redact(docs).collect()} == {1: "mail [email] or [ip]", 2: ""}


def test_empty_table(spark):
    assert pii.find_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_against_plain_search(spark, sf_dir):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = registered()["op4_personal_data"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in want] == [len(v) for v in want.values()]
        joined = ",".join(s for v in want.values() for s in v)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) - {""} <= set(r["spans"].split(","))


def test_many_finds_in_one_text(spark):
    """Tens of thousands of finds: places right, and in seconds, as the work grows with the text."""
    text = "".join(f"a{i}@ex.com tel {1000000 + i} x 10.0.{i % 200}.1 " for i in range(20_000))
    row = pii.find_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    want = plain(text)
    for kind in ("email", "ip"):
        assert [f"{kind}:{s['start']}:{s['end']}" for s in row[f"{kind}s"]] == want[kind]
    assert [s["found"] for s in row["numbers"]] == [str(1000000 + i) for i in range(20_000)]
    assert all(text[s["start"]:s["end"]] == s["found"] for s in row["numbers"])
