"""Cards beside other digits."""

import re

import pytest

from leafmill.llm import pii

CARDS = ["4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1111", "3782 822463 10005", "6304 0000 0000 0000 000"]


def _valid(s):
    d = [int(x) for x in s if x.isdigit()][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


@pytest.fixture(scope="module")
def sealed(spark):
    def run(texts):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        return [tuple(r) for r in pii.pseudonymise(docs, "k", "n").orderBy("doc_id").select("text", "n").collect()]

    return run


def test_card_beside_digits(sealed):
    around = [("", ""), ("", " 12/27"), ("", " 123"), ("", " 12"), ("", " 1 2 3 x"), ("no. ", " 12a"), ("", "-99."), ("2 ", ""), ("1 2 3 4 ", " 5")]
    texts = [a + c + b for c in CARDS for a, b in around]
    alone = {c: sealed([c])[0][0] for c in CARDS}
    assert all(alone[c] != c and _valid(alone[c]) and re.sub("[0-9]", "0", alone[c]) == re.sub("[0-9]", "0", c) for c in CARDS)
    for (c, (a, b)), (got, n) in zip([(c, x) for c in CARDS for x in around], sealed(texts), strict=True):
        assert (got, n) == (a + alone[c] + b, 1)


def test_cards_beside_each_other_and_other_values(sealed):
    a, b = "4111 1111 1111 1111", "5500 0000 0000 0004"
    (x, _), (y, _), (date, _), (ssn, _) = sealed([a, b, "2024-02-29", "123-45-6789"])
    got = sealed([f"{a} {b}", f"{a} 12 {b} 346", f"{a} 2024-02-29", f"{a} 123-45-6789", "9" * 70_000, "7 " * 3_000, "4111 1111 1111 1112 12/27"])
    assert got[:4] == [(f"{x} {y}", 2), (f"{x} 12 {y} 346", 2), (f"{x} {date}", 2), (f"{x} {ssn}", 2)]
    assert got[4] == ("9" * 70_000, 0) and len(got[5][0]) == 6_000
    assert got[6] == ("4111 1111 1111 1112 12/27", 0)
