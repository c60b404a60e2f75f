from quillon.llm import pii


def test_mentions_of_a_person_are_one_identity(spark):
    a = "Mr John Smith came. Later Mr Smith met Dr Smith; Smith's desk, JOHN SMITH and John Smith. Smithson and Smith-Jones stay."
    b = "Mrs Mary Jones and Mr Paul Jones. Mrs Jones left, Mr Jones stayed. Dr Jones too."
    c = "Then Brown spoke. Prof Brown and Ms Brown agreed."
    got = {i: [e for e in pii.detect(t) if e[2] == "person"] for i, t in enumerate((a, b, c))}
    assert [e[3] for e in got[0]] == ["m:john smith"] * 6
    assert [e[3] for e in got[1]] == ["f:mary jones", "m:paul jones", "f:mary jones", "m:paul jones", "m:paul jones"]
    assert [e[3] for e in got[2]] == ["f:brown"] * 3
    df = spark.createDataFrame([(0, a), (1, b), (2, c)], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in pii.surrogates(df, b"k").collect()}
    full = out[0].split("Mr ")[1].split(" came")[0]
    family = full.split()[1]
    assert out[0] == a.replace("JOHN SMITH", full.upper()).replace("Smith-", "@-").replace("Smithson", "@son").replace("John Smith", full).replace("Smith", family).replace("@", "Smith")
    assert "Jones" not in out[1] and "Brown" not in out[2]


def test_phone_numbers_without_separators():
    for text in ("+4915112345678", "+1 5551234567", "+49 1511 2345678", "+1 (772) 555-8768", "+1-772-555-8768"):
        (found,) = pii.detect(f"call {text}, now")
        assert (found[0], found[1], found[2]) == (5, 5 + len(text), "phone")
        assert found[3] == "".join(c for c in text if c.isdigit())
    assert pii.detect("+12345 and 4915112345679 rows, 10 000 of them, 1+1234567x") == []
    assert [e[3] for e in pii.detect("+4915112345678 12345678 rows")] == ["4915112345678"]
