"""Values are found where digits, capitals or other values follow or come before."""

import re

import pytest

from larkspur.llm import pii

CARD, IBAN = "4111 1111 1111 1111", "DE89370400440532013000"
TEXTS = [
    ("card", f"pay {CARD} 12/27 ok", r"pay 4\d{3} \d{4} \d{4} \d{4} 12/27 ok"),
    ("card", "pay 4111111111111111 123 ok", r"pay 4\d{15} 123 ok"),
    ("card", f"AB12 {CARD}", r"AB12 4\d{3} \d{4} \d{4} \d{4}"),
    ("card", f"å, 😀 7 {CARD} 12/27, 12", r"å, 😀 7 4\d{3} \d{4} \d{4} \d{4} 12/27, 12"),
    ("card", f"000-00-0000 {CARD}", r"000-00-0000 4\d{3} \d{4} \d{4} \d{4}"),
    ("iban", f"to {IBAN} I paid", r"to DE\d{20} I paid"),
    ("iban", f"to {IBAN} 2024", r"to DE\d{20} 2024"),
    ("iban", "to DE89 3704 0044 0532 0130 00 AB 7 x", r"to DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d AB 7 x"),
    ("email", "AB12 CDEFGHIJKLMN ANN@mail.com", r"AB12 CDEFGHIJKLMN [A-Z]{3}@mail\.com"),
    ("phone", "4111 1111 1111 1112 453 555 6571", r"4111 1111 1111 1112 [2-9]\d\d [2-9]\d\d \d{4}"),
]


@pytest.fixture(scope="module")
def changed(spark):
    df = spark.createDataFrame([(i, x[1]) for i, x in enumerate(TEXTS)], "id long, text string")
    return {r.id: r for r in pii.pseudonymize(df).collect()}


@pytest.mark.parametrize("i", range(len(TEXTS)))
def test_found_beside_others(changed, i):
    kind, text, form = TEXTS[i]
    got = changed[i]
    assert re.fullmatch(form, got.text) and got.text != text, got
    assert got.pii[kind] == 1 and sum(got.pii) == 1


def test_same_pseudonym_beside_others_and_alone(spark):
    df = spark.createDataFrame([(1, f"{CARD}"), (2, f"{CARD} 12/27"), (3, IBAN), (4, f"{IBAN} I")], "id long, text string")
    a, b, c, d = (r.text for r in pii.pseudonymize(df).orderBy("id").collect())
    assert b == f"{a} 12/27" and d == f"{c} I"


def test_rest_stays_as_it_is(spark):
    text = "\n a,b;  9999 9999 9999 9999 8\n\n token :\n\n é😀 1.2.3.400 x, 4111-1111-1111-1112\n 99.99.2024\n"
    got = pii.pseudonymize(spark.createDataFrame([(1, text)], "id long, text string")).first()
    assert got.text == text and sum(got.pii) == 0
