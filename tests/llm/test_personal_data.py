"""Spans against plain regular expressions."""

import hashlib
import random
import re

import pytest

from harbor.llm import personal_data
from tests.llm.tables import AWKWARD, documents


def digits(match):
    return re.sub("[^0-9]", "", match)


def luhn(match):
    total = 0
    for place, char in enumerate(reversed(digits(match))):
        value = int(char) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return 13 <= len(digits(match)) <= 19 and total % 10 == 0


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", luhn),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
]


def base_spans(text):
    return [
        f"{kind}:{m.start()}:{m.end()}" for kind, pattern, good in BASE for m in re.finditer(pattern, text) if good(m.group())
    ]


def odd_texts():
    rng = random.Random(9)
    parts = [
        *"0123456789.@+- ()ax_%é🎉\n", "a@b.c", "x.y@mail.example.org", "10.0.0.1", "256.1.1.1", "4111 1111 1111 1111",
        "4111111111111111", "+49 30 1234567", "+1 (555) 010-9999", "0255.1.2.3", "5500-0000-0000-0004", "..", "@@",
    ]
    return ["".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(800)]


def digest(spark, rows):
    found = personal_data.find_personal_data(documents(spark, rows))
    return personal_data.personal_data_digest(found).collect()


@pytest.mark.parametrize("rows", [AWKWARD, [(n, t, None) for n, t in enumerate(odd_texts())], []])
def test_base_spans(spark, rows):
    found = digest(spark, rows)
    assert len(found) == len(rows)
    expected = sorted(
        (repr(i), hashlib.sha256(",".join(base_spans(t or "")).encode()).hexdigest(),
         *(sum(s.startswith(kind) for s in base_spans(t or "")) for kind, _, _ in BASE))
        for i, t, _ in rows
    )
    assert sorted((repr(r.doc_id), r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in found) == expected
    by_id = {i: t or "" for i, t, _ in rows}
    for row in found:
        if row.doc_id is not None and sum(r[0] == row.doc_id for r in rows) == 1:
            base = [s for s in row.spans.split(",") if s.split(":")[0] in {"email", "ip", "card", "phone"}]
            assert base == base_spans(by_id[row.doc_id])


def test_checksums_and_context(spark):
    texts = [
        "iban DE89 3704 0044 0532 0130 00.", "IBAN DE89370400440532013000", "iban DE88370400440532013000",
        "my ssn is 123-45-6789", "part number 123-45-6789", "ssn 000-45-6789",
    ]
    found = personal_data.find_personal_data(documents(spark, [(n, t, None) for n, t in enumerate(texts)])).collect()
    got = {row.doc_id: [(s.kind, s.match) for s in row.found] for row in found}
    assert got == {
        0: [("iban", "DE89 3704 0044 0532 0130 00")], 1: [("iban", "DE89370400440532013000")], 2: [],
        3: [("national_id", "123-45-6789")], 4: [], 5: [],
    }
    scores = {row.doc_id: [s.score for s in row.found] for row in found}
    assert scores[0] == [pytest.approx(0.9)] and scores[3] == [pytest.approx(0.6)]


def test_account_numbers_end_where_they_pass(spark):
    austria, spain, germany = "AT61 1904 3002 3457 3201", "ES91 2100 0418 4502 0005 1332", "DE89 3704 0044 0532 0130 00"
    cases = {
        f"iban {austria} Bank": [austria], f"{spain} Please pay": [spain], f"{austria} BANK": [austria], f"{austria} 2 days": [austria],
        f"{spain} A": [spain], f"{austria} {germany} {spain}": [austria, germany, spain], f"x{austria} y": [], f"{austria}x": [],
        f"é {germany} BANK {austria}.": [germany, austria], austria.replace(" ", "") + " BANK AG": [austria.replace(" ", "")],
        "AT62 1904 3002 3457 3201 BANK": [],
    }
    found = personal_data.find_personal_data(documents(spark, [(n, t, None) for n, t in enumerate(cases)])).collect()
    got = {row.doc_id: [(s.match, s.start, s.end) for s in row.found if s.kind == "iban"] for row in found}
    assert got == {n: [(m, t.index(m), t.index(m) + len(m)) for m in ms] for n, (t, ms) in enumerate(cases.items())}
    assert [s.score for s in next(r for r in found if r.doc_id == 0).found] == [pytest.approx(0.9)]


def test_long_runs_take_linear_time(spark):
    rows = [(1, "a" * 200_000 + " b@c.d", None), (2, "1" * 200_000, None), (3, "1.1." * 50_000, None), (4, "+1" + "(" * 200_000, None)]
    found = {r.doc_id: r for r in digest(spark, rows)}
    assert found[1].n_email == 1 and found[2].n_card == 0 and found[3].n_ip == 25_000 and found[4].n_phone == 0


def test_no_python(spark):
    plan = personal_data.personal_data_digest(personal_data.find_personal_data(documents(spark)))
    assert not re.search("Python|Pandas|Arrow", plan._jdf.queryExecution().toString())
