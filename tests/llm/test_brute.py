"""Operators that SQL cannot express against brute-force versions, and the registered queries' rules of rows held out."""

import itertools
import random
import re
import zlib

import numpy as np
import zstandard as zstd

from quillon.llm import chunkdedup, crf, langid, pii, queries

SCHEMA = "doc_id long, text string"
SF = "/root/testdata/sf0.01"


def brute_spans(rows, least):
    """Repeated spans by comparing the chunks of every two documents."""
    own = []
    for d, t in rows:
        if d is None:
            continue
        raw = (t or "").encode()
        _, start, end, _ = chunkdedup.split([raw])
        own.append((d, raw, [(int(s), int(e), raw[s:e]) for s, e in zip(start, end, strict=True)]))
    places = {}
    for d, _, parts in own:
        for s, e, b in parts:
            places.setdefault(b, []).append((d, s, e))
    out = []
    by_doc = {}
    for d, raw, parts in own:
        for s, e, b in parts:
            if len({x for x, _, _ in places[b]}) > 1:
                by_doc.setdefault(d, []).append((s, e, b, raw))
    for d, hits in by_doc.items():
        hits.sort(key=lambda h: (h[0], h[1]))
        runs = []
        for h in hits:
            if runs and runs[-1]["end"] >= h[0]:
                runs[-1]["hits"].append(h)
                runs[-1]["end"] = max(runs[-1]["end"], h[1])
            else:
                runs.append({"start": h[0], "end": h[1], "hits": [h]})
        for r in runs:
            words = 0
            for s, e, _, raw in r["hits"]:
                starts = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
                words += sum(s <= x < e for x in starts)
            firsts = [min(places[b]) for _, _, b, _ in r["hits"]]
            size = sum(e - s for s, e, _, _ in r["hits"])
            mine = sum(e - s for (s, e, _, _), f in zip(r["hits"], firsts, strict=True) if f[:2] == (d, s))
            if words >= least:
                out.append((d, r["start"], r["end"], len(r["hits"]), words, min(f[0] for f in firsts), 2 * mine >= size))
    return sorted(out)


def test_repeated_spans_match_brute_force(spark):
    rnd = random.Random(3)
    vocab = ["été", "naïve", "word", "日本", "alpha", "beta", "x", "longerword", "ß", "🙂🙂"]
    text = lambda n: " ".join(rnd.choice(vocab) + str(rnd.randrange(10**6)) for _ in range(n))
    shared = [text(rnd.randint(8, 80)) for _ in range(8)]
    rows = []
    for i in range(80):
        parts = [text(rnd.randint(0, 40))]
        for _ in range(rnd.randint(0, 2)):
            parts += [rnd.choice(shared), text(rnd.randint(0, 40))]
        rows.append((i, " ".join(parts)))
    rows += [(200, None), (201, ""), (202, rows[0][1]), (None, shared[0])]
    got = chunkdedup.repeated_spans(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted((r["doc_id"], r["start"], r["end"], r["n_chunks"], r["n_words"], r["first_doc_id"], r["original"]) for r in got) == brute_spans(rows, chunkdedup.MIN_WORDS)
    by = {d: t for d, t in rows if d is not None}
    for r in got:  # no end inside a character
        raw = by[r["doc_id"]].encode()
        assert raw[r["start"] : r["end"]].decode() and raw[: r["start"]].decode() is not None
    # what dedup leaves is the text without its spans, to the byte
    out = {r["doc_id"]: r["text"] for r in chunkdedup.dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    for d, t in by.items():
        raw, at, kept = (t or "").encode(), 0, b""
        for s, e in sorted((r["start"], r["end"]) for r in got if r["doc_id"] == d and not r["original"]):
            kept += raw[at:s]
            at = e
        assert (out[d] or "").encode() == kept + raw[at:]


def test_language_id_matches_direct_compression(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in queries.op5_compression_langid(spark, SF).collect()}
    held = {r["doc_id"] for r in docs if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    assert set(got) == {r["doc_id"] for r in docs} and {d for d, r in got.items() if r["held_out"]} == held
    dictionaries = langid.train(spark.createDataFrame([(r["text"], r["lang"]) for r in docs if r["doc_id"] not in held], "text string, lang string"))
    lowered = {k: v.decode("utf-8", "ignore").lower().encode() for k, v in dictionaries.items()}
    for r in docs[::9]:
        text = r["text"]
        raw = text.lower().encode()
        n = max(1, -(-len(raw) // langid.PIECE))
        step = -(-len(raw) // n) if raw else 1
        sizes = {}
        for lang, d in lowered.items():
            p = zstd.ZstdCompressionParameters.from_level(langid.LEVEL, source_size=langid.PIECE, dict_size=len(d), write_content_size=False, write_checksum=False, write_dict_id=False)
            c = zstd.ZstdCompressor(compression_params=p, dict_data=zstd.ZstdCompressionDict(d, dict_type=zstd.DICT_TYPE_RAWCONTENT))
            sizes[lang] = sum(len(c.compress(raw[i : i + step])) for i in range(0, len(raw), step))
        best = min(sorted(sizes), key=sizes.__getitem__)
        assert got[r["doc_id"]]["lang_pred"] == (best if any(ch.isalpha() for ch in text) else "und")
    told = [r for r in docs if r["doc_id"] in held and r["lang"]]
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in told]) >= 0.95


def test_document_scores_match_enumeration(spark):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(["fine", "day", "moron", "tea", "idiot", "cup"]) for _ in range(rnd.randint(0, 7))) for _ in range(200)]
    toxic = ["moron" in t or "idiot" in t for t in texts]
    model = crf.fit(texts, toxic)
    got = {r["doc_id"]: r["score"] for r in crf.score(spark.createDataFrame(list(enumerate(texts)), SCHEMA), model).collect()}
    for d, t in list(enumerate(texts))[:60]:
        tok = crf.Tokens([t.encode()])
        emit = model.weights[tok.features].sum(axis=1, dtype=np.float64) + model.bias
        n, mass, tag = len(emit), 0.0, np.zeros(len(emit))
        for y in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(emit[i] * y[i] for i in range(n)) + sum(model.trans[y[i], y[i + 1]] for i in range(n - 1)))
            mass += w
            tag += w * np.array(y)
        p = np.sort(tag / mass)[::-1]
        x = [p[0] if n else 0.0, p[1] if n > 1 else 0.0, np.log1p(p[p >= 0.5].sum())]
        assert np.isclose(got[d], 1 / (1 + np.exp(-(model.curve[0] + np.dot(x, model.curve[1:])))), atol=1e-9)
    assert np.mean([(got[d] >= 0.7) == y for d, y in enumerate(toxic)]) > 0.97


def test_held_out_rule_of_toxicity(spark):
    for r in queries.op10_crf_toxicity(spark, "/root/testdata/sf0.001").collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.7)


def test_surrogates_against_a_direct_rewrite(spark):
    """Outside the entities nothing changes; one value has one surrogate, two values never share one, none is a value of the corpus."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r["text"] for r in queries.op7_pii_surrogates(spark, SF).collect()}
    assert set(got) == {d for d, t in docs.items() if pii.detect(t)}
    forward, values = {}, {(k, v) for t in docs.values() for *_, k, v in pii.detect(t)}
    for d, new in got.items():
        old, at, place = docs[d], 0, 0
        found = pii.detect(old)
        for i, (start, end, kind, value) in enumerate(found):
            gap = old[at:start]
            assert new[place : place + len(gap)] == gap
            place += len(gap)
            after = old[end : found[i + 1][0] if i + 1 < len(found) else len(old)]
            stop = new.index(after, place) if after else (len(new) if i + 1 == len(found) else place + end - start)
            if kind != "person":
                shown = new[place:stop] if kind in ("email", "secret", "ip") else "".join(c for c in new[place:stop] if c.isalnum())
                shown = shown.lower() if kind == "email" else shown
                assert forward.setdefault((kind, value), shown) == shown and (kind, shown) not in values
            place, at = stop, end
        assert new[place:] == old[at:]
    assert len({(k, s) for (k, _), s in forward.items()}) == len(forward)
