from __future__ import annotations

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import pii


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m)


PLAIN = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
)


def plain(text):
    spans, counts = [], []
    for name, pattern, ok in PLAIN:
        own = [f"{name}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text or "") if ok(m.group(0))]
        counts.append(len(own))
        spans += own
    return (*counts, hashlib.sha256(",".join(spans).encode()).hexdigest())


TEXTS = [
    "a@b.c_d@e.f x1.2.3.4.5.6.7.8 999.1.1.1 0001.002.3.255", "4111 1111 1111 1111 and 4111-1111-1111-1111-1 +1 (555) 123-4567. +12345678 é☃ me@ex.co.uk",
    "4111111111111111" * 30, " ".join(["4111111111111111"] * 20), "a" * 20000 + "@b.c", "1.2.3.4 " * 700, "😀 a@b.co 😀 +49 89 1234567", "4 " * 30, "+1-----2 +1 2 3 4 5 6 7 8 9((((",
    "%@a.b. @a.b a@b a@.b x@-.-", "1" * 20000, "9.9.9.9." * 50, "", None, "+" * 500 + "1", "1.1.1.1@x.y",
]


def check(make, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.digest(pii.find(make(rows))).collect()}
    assert got == {i: plain(t) for i, t in rows}


def test_base_spans_equal_plain_regular_expressions(make):
    check(make, TEXTS)


def test_base_spans_on_random_texts(make):
    texts: list[str] = []

    @settings(max_examples=400, database=None, derandomize=True)
    @given(st.text(alphabet="0123456789ab@.+- ()é😀", max_size=60))
    def collect(text):
        texts.append(text)

    collect()
    check(make, texts)


def test_method_adds_confirmed_spans(make):
    text = "account DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432, not GB83WEST12345698765432; ssn 123-45-6789, part 123-45-6788, ssn 000-12-3456"
    row = pii.digest(pii.find(make([(1, text)]))).first()
    assert (row.n_iban, row.n_ssn) == (2, 1)
    assert row.spans.startswith("iban:8:35,iban:39:61,ssn:")


def test_account_numbers_end_before_capitals_and_digits(make):
    plain_, spaced, british = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"
    cases = {
        f"{plain_} BIC COBADEFFXXX": [plain_], f"{spaced} Please": [spaced], f"{british} The": [british], f"{plain_} 42 euros": [plain_],
        f"{plain_} {british} {spaced} {plain_}": [plain_, british, spaced, plain_], f"Room AB12 {plain_} X": [plain_], "REF AL12 RO49AAAA1B31007593840000": ["RO49AAAA1B31007593840000"],
        "NO9386011117947 MT84MALT011000012345MTLCAST001S END": ["NO9386011117947", "MT84MALT011000012345MTLCAST001S"], f"é😀 {plain_}é": [plain_],
        f"{plain_}X": [], f"{plain_}x": [], "DE89370400440532013001 BIC": [], f"serial {plain_} X": [], "LC14BOSL123456789012345678901234 X": ["LC14BOSL123456789012345678901234"],
        "OM810180000001299123456 PAY": ["OM810180000001299123456"],
    }
    rows = pii.find(make(list(enumerate(cases)))).select("doc_id", "text", F.filter("pii", lambda s: s["kind"] == "iban").alias("pii")).collect()
    assert {r.text: [r.text[s.start : s.end] for s in r.pii] for r in rows} == cases
    hidden = pii.redact(make([(1, f"pay {plain_} BIC COBADEFFXXX, {spaced} Please")])).first().text
    assert hidden == "pay [IBAN] BIC COBADEFFXXX, [IBAN] Please"
    many = " ".join([plain_] * 700)
    assert [(s.start, s.end) for s in pii.find(make([(1, many)])).first().pii if s.kind == "iban"] == [(23 * i, 23 * i + 22) for i in range(700)]


def test_context_moves_the_score(make):
    found = pii.find(make([(1, "my phone +49 89 1234567"), (2, "total +49 89 1234567"), (3, "x +49 89 1234567")])).select("doc_id", F.col("pii")[0]["score"].alias("score"))
    score = {r.doc_id: r.score for r in found.collect()}
    assert score[1] > score[3] > score[2]


def test_redaction(make):
    docs = make([(1, "write a@b.c now"), (2, "4111 1111 1111 1111"), (3, None), (4, "none"), (5, "1.2.3.4@x.yz"), (None, "+49 89 1234567 end")])
    out = pii.redact(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {1: ("write [EMAIL] now", 17), 2: ("[CARD]", 6), 3: (None, None), 4: ("none", 4), 5: ("[EMAIL]", 7), None: ("[PHONE] end", 11)}


def test_plan_is_native_and_without_exchange(make):
    plan = pii.digest(pii.find(make([(1, "a@b.c")], 1)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(make):
    assert pii.digest(pii.find(make([]))).count() == 0 and pii.redact(make([])).count() == 0
