"""Every registered query on odd tables: nulls in any column, empty and very long texts, ties, repeated rows, clashing columns, empty tables."""

import pytest

from quillon.llm import queries

LONG = "the and of word " * 30_000
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = [f"{i} as {c}" for i, c in enumerate("row line keys node key place score spans h n part rep comp a b cls rank sequence_id host digest bands sig size runs hashes kind value label toxic_ lang_pred held_out range text_a slots".split())]


def rows():
    base = [(i, f"the and of thing with from number {i} that have this which were their own words of text {i * 7} and then some more of them at the end of line number {i + 3}", "aa" if i % 2 else "bb", "s", 1) for i in range(12)]
    odd = [(None, base[0][1], None, None, None), (20, None, None, None, None), (21, "", "aa", None, None), (22, " \n\t ", None, "", 0), (23, LONG, "aa", "s", len(LONG))]
    return [*base, *odd, base[3], base[3], (24, base[4][1], "aa", "s", 1), (25, base[4][1].upper(), "aa", "s", 1)]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    out = []
    for some in (rows(), []):
        d = tmp_path_factory.mktemp("edges")
        spark.createDataFrame(some, DOCS).selectExpr("*", *EXTRA).write.parquet(f"{d}/documents.parquet")
        labels = [(1, 0, 1), (2, 1, 0), (3, 0, 1), (4, 1, 0), (None, 1, 1), (5, None, None), (5, 0, 1)] if some else []
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 as h", "'x' as text").write.parquet(f"{d}/labels.parquet")
        items = [(1, rows()[1][1]), (2, None), (3, ""), (None, "x y"), (4, rows()[1][1]), (5, "two words")] if some else []
        spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id", "2 as need", "3 as h").write.parquet(f"{d}/benchmark.parquet")
        html = "<html><body><nav><a href='/'>Menu</a></nav><article><h1>Head {}</h1><p>Text of page {} with some more words</p></article></body></html>"
        pages = [*[(i, f"https://a.example/{i}", html.format(i, i)) for i in range(4)], (1, "https://a.example/1", html.format(1, 1)), (5, None, None), (6, "https://b.example/", ""), (None, "not a url", "<p>plain"), (7, "https://c.example/", "<article>" + "<p>word word word</p>" * 20_000 + "</article>")] if some else []
        spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as text", "3 as n_chars", "4 as slots", "5 as wrapper").write.parquet(f"{d}/pages.parquet")
        out.append(str(d))
    return out


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_and_empty_tables(spark, folders, name):
    full, empty = folders
    got = queries.QUERIES[name](spark, full)
    found = got.collect()
    docs = rows()
    ids = sorted((r[0] for r in docs), key=str)
    if name.startswith(("op2_", "op3_", "op5_", "op9_", "op10_", "op11_", "op12_")):
        assert sorted((r["doc_id"] for r in found), key=str) == ids
    by = {}
    for r in found:
        by.setdefault(r[next(c for c in ("doc_id", "page_id", "word") if c in got.columns)], []).append(r)
    if name.startswith("op1_"):
        assert len(found) == 9 and by[5][0]["text"] == by[6][0]["text"] == "" and by[1][0]["text"] == by[1][1]["text"] == "Head 1 Text of page 1 with some more words"
        assert by[7][0]["n_chars"] == 15 * 20_000 - 1 and by[None][0]["text"] == "plain"
    if name.startswith("op2_"):
        assert by[20][0]["fingerprint"] == by[21][0]["fingerprint"] == "" and by[4][0]["fingerprint"] == by[24][0]["fingerprint"] and by[23][0]["n_chars"] == len(LONG)
        assert len({r["fingerprint"] for r in by[3]}) == 1 and all(0 <= r[c] <= 1 for r in found for c in ("near_edited", "near_next"))
    if name.startswith("op3_"):
        assert by[24][0]["component_id"] == by[25][0]["component_id"] == 4 and by[None][0]["component_id"] is None and by[20][0]["n_shingles"] == 0 and all(r["kept"] for r in by[3])
    if name.startswith("op4_"):
        assert sorted(by, key=str) == sorted({r[0] for r in docs}, key=str) and by[20][0]["doc_tokens"] == 1 and sum(r["length"] for r in by[23]) == by[23][0]["doc_tokens"]
    if name.startswith("op5_"):
        assert {by[i][0]["lang_pred"] for i in (20, 21, 22)} == {"und"} and by[4][0]["lang_pred"] == by[24][0]["lang_pred"] and not by[None][0]["held_out"]
    if name.startswith("op6_"):
        assert None not in by and {4, 24} <= set(by) and 20 not in by
    if name.startswith("op8_"):
        assert {(r["item_id"], r["doc_id"]) for r in found} == {(1, 1), (4, 1)}
    if name.startswith("op9_"):
        assert by[20][0]["text"] is None and by[21][0]["text"] == "" and by[23][0]["text"] == LONG and by[22][0]["text"] == " \n\t "
    if name.startswith("op10_"):
        assert by[20][0]["score"] == by[21][0]["score"] and len({r["score"] for r in by[3]}) == 1
    if name.startswith("op11_"):
        assert len({r["root"] for r in found}) == 1 and by[None][0]["verified"] and {r["verified"] for r in by[3]} == {by[3][0]["verified"]}
    if name.startswith("op12_"):
        assert by[20][0]["n_words"] == by[22][0]["n_words"] == 0 and by[23][0]["n_words"] == 120_000 and {r["labels"] for r in found} == {""}
    if name.startswith("op13_"):
        assert set(by) == {"number"} and by["number"][0]["n"] >= 30
    again = queries.QUERIES[name](spark, empty)
    assert again.columns == got.columns and again.count() == 0
