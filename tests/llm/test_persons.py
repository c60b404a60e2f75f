"""Surrogates of persons: families one to one, given names apart within a family, genders over the corpus, short mentions."""

import random
import re

import pytest

from quillon.llm import pii


def test_many_persons_against_direct_checks(spark):
    rnd = random.Random(8)
    families = [f"{''.join(rnd.choice('abcdefgh') for _ in range(5))}{i}".translate(str.maketrans("0123456789", "klmnopqrst")) for i in range(30_000)] + [f"{a}{b}{c}".lower() for a in ("Ba", "Be", "Bo") for b in pii.SYLLABLES["latin"] for c in pii.SYLLABLES["latin"]] + ["smith"]
    values = {f"{rnd.choice('mfu')}:{rnd.choice(['ann', 'bob', 'cleo', 'иван'])} {rnd.choice(families)}" for _ in range(90_000)}
    values |= {f"m:given{chr(97 + i)}{chr(97 + j)} smith" for i in range(20) for j in range(5)} | {f"{rnd.choice('mfu')}:{x}" for x in rnd.sample(families, 10_000)}
    got = {r["value"]: r["surrogate"] for r in pii.assign(spark.createDataFrame([("person", v) for v in values], "kind string, value string").repartition(8), b"k").collect()}
    assert set(got) == values and len(values) > 90_000
    by_family, real = {}, {v.split(":")[1].split()[-1] for v in values}
    told = {}
    for v in values:
        if v[0] != "u":
            told.setdefault(v[2:], set()).add(v[0])
    people = {}
    for v, s in got.items():
        gender, name = v.split(":")
        assert by_family.setdefault(name.split()[-1], s.split()[-1]) == s.split()[-1]
        assert len(s.split()) == len(name.split())
        if " " in name:
            if gender == "u" and len(told.get(name, ())) == 1:
                gender = next(iter(told[name]))
            script = "cyrillic" if "а" <= name[0] <= "я" else "latin"
            assert set(s.split()[0].split("-")) <= {x for (sc, g), xs in pii.GIVEN.items() for x in xs if sc == script and gender in (g, "u")}
            people.setdefault(s, set()).add((gender, name))
    assert len(set(by_family.values())) == len(by_family) and not {s.casefold() for s in by_family.values()} & real
    assert all(len(x) == 1 for x in people.values())


def test_a_surrogate_is_no_family_of_the_corpus(spark):
    first = pii.assign(spark.createDataFrame([("person", "m:john smith")], "kind string, value string"), b"k").first()["surrogate"]
    family = first.split()[1]
    df = spark.createDataFrame([(0, "Mr John Smith came."), (1, f"Ms Ann {family} left."), (2, f"Herr {family.upper()} too, and Mr Smith.")], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in pii.surrogates(df, b"k").collect()}
    assert all(family.lower() not in t.lower() and "Smith" not in t for t in out.values())
    assert out[2].split("Mr ")[1] == out[0].split("Mr ")[1].split()[1] + "."
    assert out[2].split()[1].rstrip(",").lower() == out[1].split()[2].lower()


def test_one_gender_told_anywhere_counts_everywhere(spark):
    rows = [(0, "Dr Anna Smith spoke."), (1, "Ms Anna Smith agreed."), (2, "Mr Kim Lee and"), (3, "Ms Kim Lee and"), (4, "Prof Kim Lee.")]
    out = {r["doc_id"]: r["text"] for r in pii.surrogates(spark.createDataFrame(rows, "doc_id long, text string"), b"k").collect()}
    name = lambda i: re.sub(r"^\S+ (\S+ \w+).*", r"\1", out[i])
    assert name(0) == name(1) and name(0).split()[0] in pii.GIVEN["latin", "f"]
    assert len({name(2), name(3), name(4)}) == 3 and len({name(i).split()[1] for i in (2, 3, 4)}) == 1


def test_the_key_decides(spark):
    df = spark.createDataFrame([(0, "Mr John Smith, 0151 2345678.")], "doc_id long, text string")
    one, again, other = (pii.surrogates(df, k).first()["text"] for k in (b"a", b"a", b"b"))
    assert one == again != other and "2345678" not in one
    with pytest.raises(TypeError):
        pii.surrogates(df)
