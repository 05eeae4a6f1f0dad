"""Pseudonyms against an independent Feistel network, in all layouts of a value."""
import hashlib
import random
import re

import pytest

from trendspark.llm import pii
from trendspark.session import ship_package

KEY = "k"
DOCS = "doc_id long, text string"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def feistel(kind, values, radix, kept):
    """Eight rounds over a list of numbers; a half moves by a hash of the other."""
    v, half = list(values), len(values) // 2
    for turn in range(8):
        left = turn % 2 == 0
        other = ",".join(map(str, v[half:] if left else v[:half]))
        h = hashlib.sha512(f"{KEY}|{kind}|{turn}|{other}|{kept}".encode()).hexdigest()
        v = [(x + int(h[k % 32 * 4:k % 32 * 4 + 4], 16)) % radix[k] if (k < half) == left else x for k, x in enumerate(v)]
    return v


def luhn(digits):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits)))


def card(bare):
    v = feistel("card", [*map(int, bare[:-1]), 0], [10] * (len(bare) - 1) + [1], "0")
    return "".join(map(str, v[:-1])) + str(-luhn([*v[:-1], 0]) % 10)


def iban(bare):
    base = [0] * 4 + [48 if c.isdigit() else 65 for c in bare[4:]]
    radix = [1] * 4 + [10 if c.isdigit() else 26 for c in bare[4:]]
    text = bare[:2] + "00" + bare[4:]
    v = feistel("iban", [ord(c) - b if r > 1 else ord(c) - (48 if c.isdigit() else 65) for c, b, r in zip(text, base, radix)], radix, text[:4])
    body = "".join(chr(x + b) for x, b in zip(v[4:], base[4:]))
    check = 98 - int("".join(str(int(c, 36)) for c in body + text[:4])) % 97
    return f"{bare[:2]}{check:02d}{body}"


def phone(bare, country):
    low = [0] * country + [0 if bare[country] < "2" else 2] + [0] * (len(bare) - country - 1)
    radix = [1] * country + [2 if bare[country] < "2" else 8] + [10] * (len(bare) - country - 1)
    v = feistel("phone", [ord(c) if r == 1 else int(c) - b for c, b, r in zip(bare, low, radix)], radix, bare[:country])
    return bare[:country] + "".join(str(x + b) for x, b in zip(v[country:], low[country:]))


def laid(layout, bare):
    it = iter(bare)
    return re.sub("[0-9A-Za-z]", lambda m: next(it), layout)


def with_check(rnd, n):
    d = [rnd.randint(1, 9)] + [rnd.randint(0, 9) for _ in range(n - 2)]
    return "".join(map(str, d)) + str(-luhn([*d, 0]) % 10)


def groups(text, sep, size=4):
    return sep.join(text[i:i + size] for i in range(0, len(text), size))


def test_layouts_of_a_value_are_linked_and_as_specified(spark):
    rnd = random.Random(4)
    cases = []
    for n in (13, 15, 16, 16, 19):
        c = with_check(rnd, n)
        cases += [(x, laid(x, card(c))) for x in (c, groups(c, " "), groups(c, "-"))]
    for bare in ("DE89370400440532013000", "BE68539007547034", "GB29NWBK60161331926819"):
        cases += [(x, laid(x, iban(bare))) for x in (bare, groups(bare, " "))]
    for bare, country, layouts in (("49301234567", 2, ("+49 30 1234567", "+49-30-1234567", "+49.30.123.4567", "+49301234567")),
                                   ("5551234567", 0, ("555-123-4567", "555.123.4567", "(555) 123-4567", "(555)123 4567")),
                                   ("15551234567", 1, ("+1 555 123 4567", "+1 (555) 123-4567", "+1-555-123-4567"))):
        cases += [(x, laid(x, phone(bare, country))) for x in layouts]
    df = spark.createDataFrame([(i, f"call {x} now") for i, (x, _) in enumerate(cases)], DOCS)
    got = {r.doc_id: r.text for r in pii.pseudonymize(df, KEY).collect()}
    assert got == {i: f"call {want} now" for i, (_, want) in enumerate(cases)}


def test_different_values_stay_different(spark):
    rnd = random.Random(5)
    cards = sorted({with_check(rnd, 16) for _ in range(300)})
    out = [r.text for r in pii.pseudonymize(spark.createDataFrame(list(enumerate(cards)), DOCS), KEY).collect()]
    assert len(set(out)) == len(cards) and all(luhn(list(map(int, t))) % 10 == 0 for t in out)
