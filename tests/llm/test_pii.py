"""Anchor expansion against plain regular expressions, and what the added kinds take and leave."""

import hashlib
import random
import re

import pytest

from factloom.llm import pii
from factloom.llm.queries import queries

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = "[0-9]([\x20-]?[0-9])+"
PHONE = "\\+[0-9][\x20().0-9-]+[0-9]"


def luhn(text):
    total = 0
    for i, c in enumerate(reversed(text)):
        d = int(c) * (1 + i % 2)
        total += d if d < 10 else d - 9
    return total % 10 == 0


def plain(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    checks = {
        "email": (EMAIL, lambda m: True),
        "ip": (IP, lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        "card": (CARD, lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (PHONE, lambda m: 9 <= len(digits(m)) <= 15),
    }
    found = [(m.start(), i, m.end(), kind) for i, (kind, (pattern, ok)) in enumerate(checks.items()) for m in re.finditer(pattern, text) if ok(m)]
    return [(kind, start, end) for start, _, end, kind in sorted(found)]


def base(text):
    return [s[:3] for s in pii.spans(text) if s[3]]


CASES = [
    "", "a@b.c@d.e", "a@b@c.d", "x a@b.c. y", "a@b.c.d_e@f.g", "@b.c", "a@.c", "a@-.c", "ünö@b.de", "aü@b.de", "a@bü.de", "1.2.3.4.5.6.7.8", "1.2.3.4.5.6.7", "256.1.1.1", "0000255.1.1.01",
    "1.1.1.256.1.1.1.1", "4111111111111111", "4111 1111-1111 1111", "4111  1111 1111 1111", "41111111111111112", "0" * 12, "0" * 19, "0" * 20, "4111 1111 1111 1111 5500 0000 0000 0004", "+1 (383) 555-6083", "+123456789", "+12345678",
    "+1 2", "+1 23", "+1234567890123456", "++123456789", "+123456789+123456789", "+49 (30) 1234-5678) x", "+1.2.3.4.5.6.7.8.9", "tel:+123456789 a@b.cc", "٣٤٥ +١٢٣", "a%b+c@d-e.f-g.h" * 3,
]


@pytest.mark.parametrize("text", CASES)
def test_base_equals_patterns(text):
    assert base(text) == plain(text)


def test_base_equals_patterns_at_random():
    rng = random.Random(11)
    for alphabet in ("a1.@ ", "0123456789 -", "+()0123456789 .-", "ab@.%+-_ é1", "12.5 @+a-", "4 1-"):
        for _ in range(3000):
            text = "".join(rng.choices(alphabet, k=rng.randrange(40)))
            assert base(text) == plain(text), text
    for _ in range(500):  # numbers with right check digits
        body = "".join(rng.choices("0123456789", k=rng.randrange(11, 19)))
        text = f"x {next(body + c for c in '0123456789' if luhn(body + c))} y"
        assert base(text) == plain(text) and len(base(text)) == 1


def added(text):
    return [(k, text[a:b]) for k, a, b, own in pii.spans(text) if not own]


def test_added_kinds():
    assert added("see https://bob:pw1@host.example/x now") == [("login", "https://bob:pw1@host.example")]
    assert added("see https://host.example/x?a=b and http://a.b") == []
    assert added("call tel:555-123-4567.") == [("tel", "555-123-4567")] and added("hotel:5551234567") == []
    assert added("IBAN: DE89 3704 0044 0532 0130 00 FOR the rent") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert added("iban GB82WEST12345698765432") == [("iban", "GB82WEST12345698765432")]
    assert added("IBAN: DE88 3704 0044 0532 0130 00") == []
    assert added("SSN 123-45-6789, ssn: 000-45-6789, ssn 123-45-67890, 123-45-6789") == [("ssn", "123-45-6789")]
    assert added("Account number: 1234-5678 and passport X1234567; an account of 1234567, account 12") == [("account", "1234-5678"), ("account", "X1234567")]
    assert added("account 4111111111111111") == []  # a base span has it
    assert added("accountant 12345678, my account 2 is here, the account 123456a") == []
    assert [s[:3] for s in pii.spans("http://a:b@c.de")] == [("login", 0, 15), ("email", 9, 15)]


def test_redaction(spark):
    rows = [(1, "mail a@b.cc or +1 (383) 555-6083.", "x", "s"), (2, None, "x", "s"), (3, "", "x", "s"), (None, "nothing here", "x", "s"), (1, "http://a:b@c.de end", "x", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, spans string")
    got = pii.redact(docs)
    assert got.columns == docs.columns
    assert sorted((r["text"] or "" for r in got.collect())) == sorted(["mail [EMAIL] or [PHONE].", "", "", "nothing here", "[LOGIN] end"])
    assert [r["text"] for r in pii.redact(docs.select("text").limit(1)).collect()] == ["mail [EMAIL] or [PHONE]."]
    found = {(r["doc_id"], len(r["spans"])) for r in pii.find(docs).collect()}
    assert found == {(1, 2), (2, 0), (3, 0), (None, 0)}
    assert pii.digest(pii.find(docs.limit(0))).count() == 0 and pii.redact(docs.limit(0)).count() == 0


def test_long_text():
    """A text of millions of characters with nothing but half-made anchors is looked at once."""
    assert pii.spans("a" * 2_000_000 + "@" + "b" * 2_000_000) == []
    assert base("a@" * 300_000) == [] and len(base("1." * 300_000)) == 75_000
    assert base("1 " * 500_000) == [] and base("+1 " * 300_000) == []


def test_query(spark, sf):
    got = queries()["op12_pii"](spark, sf)
    assert got.dtypes == [("doc_id", "bigint"), *[(f"n_{k}", "bigint") for k in pii.BASE], ("base_sha256", "string"), ("spans", "string")]
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = got.collect()
    assert {r["doc_id"] for r in rows} == set(texts) and any(r["n_email"] for r in rows) and any(r["n_phone"] for r in rows)
    for r in rows:
        expect = plain(texts[r["doc_id"]])
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in expect)
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(e[0] == k for e in expect) for k in pii.BASE]
        assert set(told.split(",")) <= {*r["spans"].split(","), ""}
