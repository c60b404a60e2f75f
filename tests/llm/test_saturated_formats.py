"""Surrogates where a format's values are all taken, and distinctness, format and type over many values."""

import random
import re

import pytest

from quillon.llm import pii


@pytest.mark.parametrize("values", [
    [("email", f"{a}@{b}.de") for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghij"] + [("email", f"{a}@{b}.de") for a in "abcdefghijklmnopqrstuvwxyz" for b in "klmnopqrstuvwxyz"],
    [("iban", None)],
], ids=["email", "kinds"])
def test_saturated(spark, values):
    if values[0][1] is None:
        values = [("card", str(x)) for x in range(10_000, 10_100) if pii.luhn(str(x))] + [("person", "m:bo"), ("person", "f:ba")]
    got = pii.assign(spark.createDataFrame(values, "kind string, value string"), b"k").collect()
    assert len(got) == len(values) == len({(r["kind"], r["surrogate"]) for r in got})
    assert not {(r["kind"], r["surrogate"]) for r in got} & set(values)
    for r in got:
        if r["kind"] == "email":
            assert re.fullmatch(r"[a-z]\d*@[a-z]\.de", r["surrogate"])
        if r["kind"] == "card":
            assert pii.luhn(r["surrogate"])


def test_many_values_against_direct_checks(spark):
    rnd = random.Random(4)
    d = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    values = set()
    while len(values) < 20_000:
        kind = rnd.choice(["email", "phone", "ssn", "ip", "secret", "card", "person"])
        if kind == "card":
            body = d(15)
            value = next(body + x for x in "0123456789" if pii.luhn(body + x))
        else:
            value = {"email": f"u{d(4)}.x@mail{d(1)}.org", "phone": "49" + d(10), "ssn": d(9), "ip": f"{rnd.randint(1, 223)}.{rnd.randint(0, 255)}.{rnd.randint(0, 255)}.{rnd.randint(1, 254)}", "secret": "tk" + d(8), "person": f"{rnd.choice('mfu')}:{rnd.choice(['anna', 'Иван'.lower()])} {rnd.choice('abcdefgh')}name{rnd.choice('abcdefgh')}"}[kind]
        values.add((kind, value))
    got = {(r["kind"], r["value"]): r["surrogate"] for r in pii.assign(spark.createDataFrame(sorted(values), "kind string, value string"), b"k").collect()}
    assert set(got) == values and len({(k, s) for (k, _), s in got.items()}) == len(values)
    assert not {(k, s) for (k, _), s in got.items()} & values
    for (kind, value), s in got.items():
        if kind in ("email", "phone", "ssn", "secret", "card"):
            shape = lambda x: re.sub("[0-9]", "0", re.sub("[a-z]", "a", x))
            assert shape(s) == shape(value), (kind, value, s)
        if kind == "card":
            assert pii.luhn(s)
        if kind == "person":
            gender, _, name = value.partition(":")
            script = "cyrillic" if name[0] > "я" or "а" <= name[0] <= "я" else "latin"
            assert s.split()[0] in {g for (sc, ge), names in pii.GIVEN.items() for g in names if sc == script and gender in (ge, "u")}
