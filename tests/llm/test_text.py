import random
import zlib

import numpy as np

from quillon.llm import chunkdedup, crf, langid, packing, pii, wrapper

SCHEMA = "doc_id long, text string"
SF = "/root/testdata/sf0.001"


def test_language_id(spark):
    rnd = random.Random(1)
    words = {"aa": ["the", "and", "of", "thing", "with"], "bb": ["der", "und", "nicht", "schön", "mit"], "cc": ["que", "los", "para", "señor", "con"]}
    rows = [(i, " ".join(rnd.choice(words[lang]) for _ in range(rnd.randint(5, 60))), lang) for i, lang in enumerate(random.Random(2).choices(list(words), k=150))]
    rows += [(900, None, None), (901, "", None), (902, "123 !!", "aa"), (903, "the and of", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    dictionaries = langid.train(df.where("doc_id % 3 <> 0"))
    assert set(dictionaries) == set(words)
    told = langid.teller(spark, dictionaries)
    got = {r["doc_id"]: r for r in df.select("doc_id", told("text").alias("t")).select("doc_id", "t.*").collect()}
    assert np.mean([got[d]["lang_pred"] == lang for d, _, lang in rows[:150]]) > 0.98
    assert [got[d]["lang_pred"] for d in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.train(df.limit(0)) == {}
    assert langid.Encoder({}).classify("abc") == ("und", 0.0)


def test_long_text_is_classified_whole():
    e = langid.Encoder({"aa": b"the and of thing with " * 50, "bb": b"der und nicht mit ein " * 50})
    assert e.classify("the and of " * 20_000)[0] == "aa"
    assert e.classify("the and of " * 100 + "der und nicht " * 1000)[0] == "bb"


def test_ids_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    texts = ["", " ", "a", " a", "a ", "a  b", "a   b", "x\n\n y", "x \n y", "tab\t y", "l'été où  ça", "<|endoftext|> end", "don't 12 3.5 !!", "   a b", "日本 語 🙂 b", "a  b", "end \n", " \n a"]
    rnd = random.Random(5)
    texts += ["".join(rnd.choice("ab \n\t.'é 1") for _ in range(rnd.randint(0, 30))) for _ in range(400)]
    got = packing.Encoder(path).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_packing_round_trip(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(10_001, None), (10_002, ""), (10_003, "a " * 9000)], SCHEMA)
    rows = docs.union(more).collect()
    got = packing.pack(spark.createDataFrame(rows, SCHEMA)).collect()
    ids = {r["doc_id"]: x + np.array([1], "<u4").tobytes() for r, x in zip(rows, packing.Encoder(packing.tokenizer_path()).encode([r["text"] or "" for r in rows]), strict=True)}
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(ids)
    for d, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[d]) // 4
            assert r["ids_crc32"] == zlib.crc32(ids[d][4 * at : 4 * (at + r["length"])])
            at += r["length"]
        assert at == len(ids[d]) // 4
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    tokens = sum(r["length"] for r in got)
    assert len(by_seq) <= 1.05 * tokens / 2048 + 3
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_column_generation_is_near_the_bound():
    rnd = random.Random(4)
    histogram = {n: rnd.randint(1, 400) for n in rnd.sample(range(1, 129), 40)}
    runs = packing.plan(histogram, 128)
    assert {c: int(g["count"].sum()) for c, g in runs.groupby("cls")} == histogram
    used = {}
    for r in runs.itertuples():
        for i in range(-(-r.count // r.per)):
            used[r.sequence + i] = used.get(r.sequence + i, 0) + r.per * r.cls
    assert max(used.values()) <= 128
    assert len(used) <= sum(n * k for n, k in histogram.items()) / 128 * 1.02 + 8
    assert len(packing.plan({}, 128)) == 0


def test_gear_boundaries_resist_insertions():
    rnd = random.Random(6)
    text = bytes(rnd.choice(b"abcdefghij klmn") for _ in range(4000))
    a = {text[s:e] for _, s, e, _ in zip(*chunkdedup.split([text]), strict=True)}
    moved = b"inserted at the front " + text
    b = {moved[s:e] for _, s, e, _ in zip(*chunkdedup.split([moved]), strict=True)}
    assert len(a - b) <= 2
    doc, start, end, _ = chunkdedup.split([text, b"", b"x", b"y" * 5000])
    for d, t in enumerate([text, b"", b"x", b"y" * 5000]):
        at = 0
        for s, e in zip(start[doc == d], end[doc == d], strict=True):
            assert s == at
            at = e
        assert at == len(t)


def test_repeated_spans(spark):
    rnd = random.Random(8)
    text = lambda n: " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8))) for _ in range(n))
    shared = [text(60) for _ in range(5)]
    rows, planted = [], set()
    for i in range(60):
        t = text(rnd.randint(0, 200))
        if i % 3 == 0:
            t = t + " " + shared[i % 5] + " " + text(rnd.randint(0, 50))
            planted.add(i)
        rows.append((i, t))
    alone = text(70)
    rows += [(100, None), (101, ""), (102, alone + " " + alone), (None, shared[0])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = chunkdedup.repeated_spans(df).collect()
    assert {r["doc_id"] for r in got} == planted
    out = {r["doc_id"]: r["text"] for r in chunkdedup.dedup(df).collect()}
    assert len(out) == len(rows) and out[102] == rows[62][1] and out[100] is None
    kept = [i for i in planted if len(out[i]) == len(rows[i][1])]
    assert len(kept) == 5
    assert chunkdedup.repeated_spans(df.limit(0)).count() == 0


def test_pii(spark):
    a = "Mail ann.b-3@mail7.example.com or +1 (772) 555-8768, card 4725 2176 7427 5454 / 4725217674275454, ip 227.5.221.1."
    b = 'Dr. Anna Smith and Mr Bob Stone; token = "373e80f4fc42f278a10f9d58d9086463398fa5cb" password=7421e99742ead6d50b'
    c = "ANN.B-3@MAIL7.EXAMPLE.COM again; iban DE89 3704 0044 0532 0130 00; Mr Bob Stone; version 1.2.3, year 2024, 10 000 rows"
    rows = [(1, a), (2, b), (3, c), (4, "nothing here, 3 of 4"), (5, None), (6, ""), (1, a)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA + ", kind int")
    out = {(r["doc_id"], r["kind"]): r["text"] for r in pii.surrogates(df, b"k").collect()}
    assert len(out) == 7 and out[4, 3] == rows[3][1] and out[5, 4] is None and out[6, 5] == ""
    assert out[1, 0] == out[1, 6] != a
    everything = " ".join(x or "" for x in out.values())
    for secret in ("ann.b-3", "555-8768", "47252176", "4725 2176", "227.5.221.1", "Smith", "Stone", "373e80f4", "7421e997", "3704 0044"):
        assert secret not in everything
    new = {e[2]: e[3] for e in pii.detect(out[1, 0])}
    assert pii.luhn(new["card"]) and set(new) == {"email", "phone", "card", "ip"}
    cards = [e for e in pii.detect(out[1, 0]) if e[2] == "card"]
    assert len(cards) == 2 and cards[0][3] == cards[1][3]
    assert new["email"].upper() in out[3, 2]
    assert out[2, 1].split("Mr ")[1].split(";")[0] == out[3, 2].split("Mr ")[1].split(";")[0]
    assert "version 1.2.3, year 2024, 10 000 rows" in out[3, 2]
    assert pii.changed(df.limit(0).select("doc_id", "text"), b"k").count() == 0


def test_pii_collisions_are_resolved(spark):
    values = spark.createDataFrame([("ip", f"10.0.0.{i}") for i in range(1, 200)] + [("phone", f"{i:02d}") for i in range(60)], "kind string, value string")
    got = pii.assign(values, b"k").collect()
    assert len({(r["kind"], r["surrogate"]) for r in got}) == len(got) == 259
    assert not {r["surrogate"] for r in got} & {r["value"] for r in got}


def test_crf_gradient_and_marginals():
    rng = np.random.default_rng(0)
    emit, trans = rng.normal(size=7), rng.normal(size=(2, 2))
    first, last = np.array([0, 3]), np.array([2, 6])
    p, pair, logz = crf.marginals(emit, first, last, trans, expect=True)
    want, want_pair, total = np.zeros(7), np.zeros((2, 2)), 0.0
    for a, z in ((0, 2), (3, 6)):
        n, mass, tag, pairs = z - a + 1, 0.0, np.zeros(z - a + 1), np.zeros((2, 2))
        for bits in range(2**n):
            y = [(bits >> i) & 1 for i in range(n)]
            w = np.exp(sum(emit[a + i] * y[i] for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in range(n - 1)))
            mass += w
            tag += w * np.array(y)
            for i in range(n - 1):
                pairs[y[i], y[i + 1]] += w
        want[a : z + 1], total = tag / mass, total + np.log(mass)
        want_pair += pairs / mass
    assert np.allclose(p, want) and np.allclose(pair, want_pair) and np.isclose(logz, total)


def test_toxicity(spark):
    rnd = random.Random(3)
    clean = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6))) + rnd.choice(["", "", "."]) for _ in range(n))
    rows, labels = [], []
    for i in range(300):
        t = clean(rnd.randint(5, 80))
        toxic = i % 4 == 0
        if toxic:
            t = t + " " + rnd.choice(["Moron", "idiot", "vilexx", "vileyy", "vilezz"]) + ", " + clean(8) + rnd.choice([" idiot", " moron!"])
        rows.append((i, t))
        labels.append((i, int(toxic)))
    rows += [(900, None), (901, ""), (902, "a " * 30_000 + "idiot moron")]
    df = spark.createDataFrame(rows, SCHEMA)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = crf.train(df.where("doc_id % 3 <> 1"), lab.where("doc_id % 3 <> 1"))
    got = {r["doc_id"]: r["score"] for r in crf.score(df, model).collect()}
    assert all((got[i] >= 0.7) == bool(y) for i, y in labels if i % 3 == 1)
    assert got[900] == got[901] < 0.3 and got[902] >= 0.7
    spans = crf.spans(df.where("doc_id = 902"), model).collect()
    assert [(r["start"], r["end"]) for r in spans] == [(60_000, 60_011)]
    assert crf.train(df, lab.limit(0)).prior == 0.0
    assert {r["score"] for r in crf.score(df, crf.train(df, lab.where("toxic = 0"))).collect()} == {0.0}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><h2>Site {i}</h2></header><nav><ul><li><a href="/a">Menu{i}</a></li><li><a href="/b">B</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div>{open}<h1>Head {i}&amp;co</h1><p>First <b>bo</b>ld&nbsp;text<br>line {i}<p>Second   part</p>{more}
<div class="ad">Buy now</div>{close}<div id="comments"><p>Nice post {i}</p></div><aside>Side</aside><form><label>Name</label><input></form><footer>&copy; F {i}</footer>"""


def pages():
    rows = []
    for i in range(12):
        more = "".join(f"<p>Extra paragraph number {k} of page {i} says a little more than before</p>" for k in range(i % 4))
        own = "".join(f" Extra paragraph number {k} of page {i} says a little more than before" for k in range(i % 4))
        rows.append((i, "https://a.example/x", PAGE.format(i=i, open="<article>", close="</article>", more=more), f"Head {i}&co First bold text line {i} Second part{own}"))
        long = f"This is the one long paragraph of page {i} with enough words to count as prose in any case"
        html = PAGE.format(i=i, open="<div>", close="</div>", more=more).replace("First <b>bo</b>ld&nbsp;text<br>line", long).replace("Second   part", long)
        rows.append((100 + i, "http://b.example:80/y", html, f"Head {i}&co {long} {i} {long}{own}"))
    return rows + [(200, "https://a.example/", None, ""), (201, None, "", ""), (202, "https://c.example/", "plain text without any markup at all in this page", "plain text without any markup at all in this page")]


def test_wrapper_extraction(spark):
    rows = pages()
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in wrapper.articles(df).collect()}
    for i, _, _, want in rows:
        assert got[i]["text"] == want, (i, got[i]["text"], want)
        assert got[i]["n_chars"] == len(want)
    assert wrapper.articles(df.limit(0)).count() == 0
    assert {r["page_id"]: r["text"] for r in wrapper.articles(df, broadcast_hosts=0).collect()} == {i: x for i, _, _, x in rows}


def test_wrappers_fold_and_align():
    a = wrapper.fold(["ul", "li", "#", "/li", "li", "#", "/li", "li", "#", "/li", "/ul"])
    assert a == ["ul", ("+", ("li", "#", "/li")), "/ul"]
    b = ["ul", "li", "#", "/li", "/ul"]
    assert wrapper.align(a, b) == a and wrapper.align(b, a) == a
    c = wrapper.align(["p", "#", "/p"], ["h1", "#", "/h1", "p", "#", "/p"])
    assert c == [("?", ("h1", "#", "/h1")), "p", "#", "/p"]
    assert wrapper.decode(wrapper.encode(c)) == c
    assert wrapper.slots(c) == {">h1", ">p"}


def test_wrapper_keeps_blocks_of_pages_that_differ_in_one_tag(spark):
    prose = "of page {i} has quite enough words in it to count as prose in any case"
    rows = []
    for i in range(40):
        h = "h2" if i % 2 else "h3"
        rows.append((i, "https://d.example/", f"<article><{h}>Head {i}</{h}><p>Body {i}</p></article>", f"Head {i} Body {i}"))
        box = "a" if i % 2 else "b"
        rows.append((100 + i, "https://e.example/", f'<div><div><div class="{box}">Text {prose.format(i=i)}</div></div></div>', f"Text {prose.format(i=i)}"))
        same, own = "The first paragraph has the same words on every page of this host", f"The second one {prose.format(i=i)}"
        rows.append((200 + i, "https://f.example/", f"<div><p>{same}</p><p>{own}</p></div><h4>Not prose</h4>", f"{same} {own}"))
        tags = "".join(f"<{t}>{t} {i}</{t}>" for k, t in enumerate(("h2", "p", "ul", "pre", "blockquote", "h5")) if (i + 1) >> k & 1)
        rows.append((300 + i, "https://g.example/", f"<main>{tags}</main>", " ".join(f"{t} {i}" for k, t in enumerate(("h2", "p", "ul", "pre", "blockquote", "h5")) if (i + 1) >> k & 1)))
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in wrapper.articles(df).collect()}
    assert got == {i: want for i, _, _, want in rows}


def test_wrapper_knows_every_path_of_its_pages():
    rnd = random.Random(7)

    def run(depth):
        out = []
        for _ in range(rnd.randint(0, 4)):
            if depth and rnd.random() < 0.6:
                tag = rnd.choice(["div", "ul", "h2", "h3"])
                out += [tag, *run(depth - 1), "/" + tag]
            else:
                out.append("#")
        return out

    for _ in range(300):
        streams = [run(4) for _ in range(4)]
        want = set().union(*(wrapper.slots(x) for x in streams))
        merged = wrapper.fold(streams[0])
        for x in streams[1:]:
            merged = wrapper.align(merged, wrapper.fold(x))
        assert wrapper.slots(wrapper.decode(wrapper.encode(merged))) == want
    deep = ["div"] * 3000 + ["#"] + ["/div"] * 3000
    assert len(wrapper.slots(wrapper.align(deep, [*deep[:3000], "p", "#", "/p", *deep[3001:]]))) == 2
