"""License scans against regular expressions tried at every word, and on odd texts."""

import random
import re

import pytest

from quillon.llm import licensescan as L

RUN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut(text):
    return RUN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def pattern(template):
    """The template's language as a pattern over words that each end with a space."""
    out = ""
    for part in re.split("(<<.*?>>)", template):
        if part == "<<optional>>":
            out += "(?:"
        elif part == "<<end>>":
            out += ")?"
        elif part.startswith("<<var"):
            counts, _, own = part[6:-2].partition(" ")
            out += f"(?:(?:{own or '[^ ]+'}) ){{{counts.replace('-', ',')}}}"
        else:
            out += "".join(re.escape(w) + " " for w in cut(part))
    return re.compile(out)


def brute(text, templates=L.TEMPLATES, phrases=L.PHRASES):
    w = cut(text)
    spans = []
    all_ = [(n, True, pattern(p)) for n, p in phrases.items()] + [(n, False, pattern(t)) for n, ts in templates.items() for t in ts]
    for i in range(len(w)):
        for name, base, p in all_:
            for k in range(min(len(w) - i, 400), 0, -1):
                if p.fullmatch("".join(x + " " for x in w[i : i + k])):
                    spans.append((i, k, name, base))
                    break
    starts = [i for i, _, _, base in spans if base]
    covered = {j for i, k, _, _ in spans for j in range(i, i + k)}
    names = lambda only: ",".join(sorted({n for _, _, n, base in spans if base or not only}))
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), names(True), names(False), len(covered) / len(w) if w else 0.0


def plain(template, rnd):
    """A text of the template's language."""
    out, keep = "", [True]
    for part in re.split("(<<.*?>>)", template):
        if part == "<<optional>>":
            keep.append(rnd.random() < 0.5)
        elif part == "<<end>>":
            keep.pop()
        elif all(keep):
            if part.startswith("<<var"):
                counts, _, own = part[6:-2].partition(" ")
                a, b = map(int, counts.split("-"))
                out += " ".join({"": "Acme", "[1-4]": "4", "[05]": "0"}[own] for _ in range(rnd.randint(a, b))) + " "
            else:
                out += part
    return out


def texts():
    rnd = random.Random(5)
    lines = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0."]
    out = [None, "", " \n..!", "ÄÖ é under THE mit  license-under the MIT\nlicense x", "apache license version", "cc by", "CC BY-NC-SA 4.0", "ccby nc", "under the mit licenses", "GNU General Public License version"]
    out += [f"Some prose here.\n{x}" for x in lines] + [" ".join(lines)] + [x[:-4] for x in lines]
    small = [t for ts in L.TEMPLATES.values() for t in ts if len(t) < 700]
    for _ in range(25):
        t = plain(rnd.choice(small), rnd)
        if rnd.random() < 0.4:
            w = t.split()
            w[rnd.randrange(len(w))] = "changed"
            t = " ".join(w)
        out.append("Before it the " + t + " and after.")
    return out


def test_against_patterns_at_every_word(spark):
    rows = list(enumerate(texts()))
    rows += [rows[3], (None, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as spans").repartition(3)
    found = L.scan(docs).collect()
    assert sorted((r[:8] for r in found), key=str) == sorted(((i, *brute(t)) for i, t in rows), key=str)
    kept = {r["doc_id"]: r for r in found}
    assert kept[12]["labels"] == "gpl-3" and kept[12]["base_labels"] == "" and kept[13]["labels"] == "cc-by-nc"
    assert L.scan(docs.limit(0)).count() == 0


@pytest.mark.parametrize("label", sorted(L.TEMPLATES))
def test_wording_must_be_exact(label):
    """Every choice of the optional and replaceable regions is accepted, and no text with a mandatory word changed."""
    rnd = random.Random(label)
    for t in L.TEMPLATES[label]:
        a = L.Automaton(t)
        for _ in range(5):
            w = cut(plain(t, rnd))
            assert a.match(w.__getitem__, len(w)) == len(w)
        w = cut(t) if "<<" not in t else []
        for k in range(len(w)):
            assert a.match([*w[:k], "changed", *w[k + 1 :]].__getitem__, len(w)) == 0


def test_long_texts_are_read_by_parts(spark, monkeypatch):
    rnd = random.Random(6)
    lines = ["word", "of the", "under the mit license", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "x" * 90, "Permission to use, copy"]
    text = " ".join(rnd.choice(lines) for _ in range(4000))
    scanner = L.Scanner(L.TEMPLATES, L.PHRASES)
    monkeypatch.setattr(L, "PART", 1 << 30)
    whole = L._long(scanner, text.encode())
    monkeypatch.setattr(L, "PART", 2000)
    assert L._long(scanner, text.encode()) == whole and whole[0] == len(cut(text))
    assert L.summary(scanner, *whole)["n_base"] == len(re.findall("under the mit license|apache license version 2|cc by nc", " ".join(cut(text))))


def test_markup_errors():
    for bad in ("<<optional>>a", "<<strange>> b", "<<optional>>a<<end>>"):
        with pytest.raises(ValueError):
            L.Automaton(bad)
