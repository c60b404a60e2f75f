from quillon.llm import langid


def test_a_language_of_copies_has_a_dictionary(spark):
    base = [("aa", f"the thing of number {i}") for i in range(300)]
    few = [(f"l{k}", f"text {i} of language {k}") for k in range(6) for i in range(3)]
    copies = spark.createDataFrame(few, "lang string, text string").crossJoin(spark.range(2000)).select("lang", "text")
    docs = spark.createDataFrame(base, "lang string, text string").union(copies)
    got = langid.train(docs)
    assert set(got) == {"aa", *(f"l{k}" for k in range(6))}
    for k in range(6):
        assert all(f"text {i} of language {k}".encode() in got[f"l{k}"] for i in range(3))
    assert got == langid.train(docs.distinct())
