"""License scans: license wording found in whole texts by token automata compiled from template markup.

A template is wording with markup: `<<optional>> ... <<end>>` may be left out as a whole, and
`<<var 1-8>>` or `<<var 1-2 [0-9]+>>` stands for so many words of one's own, each of the pattern if
one is given. All other words are mandatory. A template is compiled into an automaton over words; it
accepts at a place of a text where the words from there on spell the mandatory wording exactly.

Words are runs of ASCII letters and digits and of all characters from U+0080 on, A-Z lower-cased. A
batch of texts is cut into words and hashed as one array; only places whose first two words can begin
a template are read by its automaton, word by word, so hashes select places and decide nothing.
A null, empty or wordless text has no words, no labels and the score 0. Texts may have any length:
they are read by parts that overlap by the longest wording. Repeated rows are scanned each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import arrow_batches
from .hashing import Words

SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])

#: The phrases of the base labels.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
<<var 0-1>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
<<var 0-1>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY <<var 1-12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
_GNU = "<<optional>>as published by the Free Software Foundation<<end>> <<optional>>either<<end>> <<optional>>version<<end>> <<optional>>v<<end>>"
_CC = "<<optional>>Attribution<<end>>"

#: License wording, by label. Mandatory words are those outside the markup.
TEMPLATES: dict[str, list[str]] = {
    "mit": [
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice <<optional>>(including the next paragraph)<<end>> shall be included in all copies or substantial portions of the Software.""",
        "SPDX-License-Identifier: MIT",
    ],
    "apache-2": [
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.""",
        "Licensed under the Apache License <<optional>>Version<<end>> 2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd-2-clause": [f"{_BSD} {_BSD_END}", "SPDX-License-Identifier: BSD-2-Clause"],
    "bsd-3-clause": [
        f"{_BSD} <<var 0-1>> Neither the name of <<var 1-12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "isc": [
        "Permission to use, copy, modify, and<<optional>>/or<<end>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ],
    "gpl-2": [f"GNU General Public License {_GNU} 2", "GNU GPL <<optional>>version<<end>> <<optional>>v<<end>> 2", "GPLv2", "SPDX-License-Identifier: GPL-2.0"],
    "gpl-3": [f"GNU General Public License {_GNU} 3", "GNU GPL <<optional>>version<<end>> <<optional>>v<<end>> 3", "GPLv3", "SPDX-License-Identifier: GPL-3.0"],
    "lgpl-2.1": [f"GNU Lesser General Public License {_GNU} 2.1", "SPDX-License-Identifier: LGPL-2.1"],
    "lgpl-3": [f"GNU Lesser General Public License {_GNU} 3", "SPDX-License-Identifier: LGPL-3.0"],
    "agpl-3": [f"GNU Affero General Public License {_GNU} 3", "SPDX-License-Identifier: AGPL-3.0"],
    "mpl-2": ["Mozilla Public License <<optional>>version<<end>> <<optional>>v<<end>> 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by": ["licensed under <<optional>>a<<end>> <<optional>>the<<end>> CC BY <<var 1-1 [1-4]>> <<var 1-1 [05]>>", f"Creative Commons {_CC} <<var 1-1 [1-4]>> <<var 1-1 [05]>> <<optional>>International<<end>> <<optional>>Generic<<end>> <<optional>>Unported<<end>> License"],
    "cc-by-sa": ["CC BY SA <<optional>><<var 1-1 [1-4]>> <<var 1-1 [05]>><<end>>", f"Creative Commons {_CC} ShareAlike", "Creative Commons Attribution Share Alike"],
    "cc-by-nc": ["CC BY NC <<optional>><<var 1-1 [1-4]>> <<var 1-1 [05]>><<end>>", f"Creative Commons {_CC} NonCommercial", "Creative Commons Attribution Non Commercial"],
    "cc-by-nd": ["CC BY ND <<optional>><<var 1-1 [1-4]>> <<var 1-1 [05]>><<end>>", f"Creative Commons {_CC} NoDerivatives"],
    "cc-by-nc-sa": ["CC BY NC SA <<optional>><<var 1-1 [1-4]>> <<var 1-1 [05]>><<end>>", f"Creative Commons {_CC} NonCommercial ShareAlike"],
    "cc-by-nc-nd": ["CC BY NC ND <<optional>><<var 1-1 [1-4]>> <<var 1-1 [05]>><<end>>", f"Creative Commons {_CC} NonCommercial NoDerivatives"],
    "cc0": ["CC0 1.0 <<optional>>Universal<<end>>", "Creative Commons Zero"],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}


def words(text: str) -> list[str]:
    """The words of a text, for short texts such as templates."""
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]


class Automaton:
    """A template's automaton: each state has moves (word, pattern or None for any word, next state) and silent moves."""

    def __init__(self, template: str):
        self.moves: list[list[tuple[str | re.Pattern | None, int]]] = [[]]
        self.silent: list[list[int]] = [[]]
        self.mandatory = 0
        at, opened = 0, []
        for part in re.split(r"(<<[^<>]*>>)", template):
            if part == "<<optional>>":
                opened.append(at)
            elif part == "<<end>>":
                self.silent[opened.pop()].append(at)
            elif part.startswith("<<var "):
                counts, _, pattern = part[6:-2].partition(" ")
                least, most = map(int, counts.split("-"))
                skip = []
                for k in range(most):
                    if k >= least:
                        skip.append(at)
                    at = self._step(at, re.compile(pattern) if pattern else None)
                for s in skip:
                    self.silent[s].append(at)
            elif part.startswith("<<"):
                raise ValueError(f"unknown markup {part}")
            else:
                for w in words(part):
                    at = self._step(at, w)
                    self.mandatory += not opened
        if opened:
            raise ValueError("an optional region has no end")
        self.accept = at
        self.closed = [frozenset(self._reach(s)) for s in range(len(self.moves))]
        if self.accept in self.closed[0]:
            raise ValueError("a template needs a mandatory word")
        #: No match has more words: every move goes to a state of a higher number.
        self.longest = len(self.moves) - 1

    def _step(self, at: int, what) -> int:
        self.moves.append([])
        self.silent.append([])
        self.moves[at].append((what, len(self.moves) - 1))
        return len(self.moves) - 1

    def _reach(self, s: int) -> set[int]:
        out, todo = {s}, [s]
        while todo:
            for x in self.silent[todo.pop()]:
                if x not in out:
                    out.add(x)
                    todo.append(x)
        return out

    def step(self, states: frozenset[int], word: str) -> frozenset[int]:
        out: set[int] = set()
        for s in states:
            for what, to in self.moves[s]:
                if what is None or (what == word if isinstance(what, str) else what.fullmatch(word)):
                    out |= self.closed[to]
        return frozenset(out)

    def match(self, word, n: int) -> int:
        """Words of the longest match that begins with word(0), 0 if there is none; n words are there."""
        states, found, k = self.closed[0], 0, 0
        while states and k < n:
            states = self.step(states, word(k))
            k += 1
            if self.accept in states:
                found = k
        return found

    def starts(self) -> list[tuple[object, object]]:
        """The (first, second) moves of all matches; second is "" where one word may be all."""
        out = []
        for s in self.closed[0]:
            for first, to in self.moves[s]:
                if self.accept in self.closed[to]:
                    out.append((first, ""))
                out += [(first, second) for t in self.closed[to] for second, _ in self.moves[t]]
        return out


class Scanner:
    """All automata, and the pairs of words that any of them can begin with."""

    def __init__(self, templates: dict[str, list[str]], phrases: dict[str, str]):
        self.automata = [(label, True, Automaton(p)) for label, p in phrases.items()]
        self.automata += [(label, False, Automaton(t)) for label, ts in templates.items() for t in ts]
        pairs = [(i, *p) for i, (_, _, a) in enumerate(self.automata) for p in a.starts()]
        if any(not isinstance(first, str) for _, first, _ in pairs):
            raise ValueError("a template begins with a mandatory word")
        known = sorted({x for _, first, second in pairs for x in (first, second) if isinstance(x, str) and x})
        hashes = Words([w.encode() for w in known], SEPARATORS).hashes() if known else np.zeros(0, dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        place = {known[j]: i + 1 for i, j in enumerate(order)}
        n = len(known) + 1
        self.by_pair, self.by_word = {}, {}
        for i, first, second in pairs:
            if isinstance(second, str) and second:
                self.by_pair.setdefault(place[first] * n + place[second], set()).add(i)
            else:
                self.by_word.setdefault(place[first], set()).add(i)
        self.n = n
        self.pairs = np.array(sorted(self.by_pair), dtype=np.int64)
        self.firsts = np.array(sorted(self.by_word), dtype=np.int64)
        self.longest = max((a.longest for _, _, a in self.automata), default=1)

    def spans(self, w: Words) -> Iterator[tuple[int, int, int, int]]:
        """(text, first word, words, automaton) of all matches; words count from the start of their text."""
        hashes = w.hashes()
        if not len(hashes):
            return
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        ids = np.where(self.hashes[at] == hashes, at + 1, 0).astype(np.int64)
        pair = ids * self.n + np.append(ids[1:], 0)
        hit = np.flatnonzero((ids > 0) & (np.isin(pair, self.pairs) | np.isin(ids, self.firsts)))
        texts = np.searchsorted(w.offsets, hit, side="right") - 1
        for place, text in zip(hit.tolist(), texts.tolist(), strict=True):
            first, end = int(w.offsets[text]), int(w.offsets[text + 1])

            def word(k, place=place):
                b = w.buffer[w.start[place + k] : w.end[place + k]].tobytes()
                return b.lower().decode("utf-8", "surrogatepass")  # bytes.lower changes A-Z only

            for i in sorted(self.by_pair.get(int(pair[place]), set()) | self.by_word.get(int(ids[place]), set())):
                if n := self.automata[i][2].match(word, end - place):
                    yield text, place - first, n, i


#: Bytes of text that are cut into words at once.
PART = 1 << 22
_SEPARATOR = re.compile(b"[" + re.escape(SEPARATORS) + b"]")


def parts(text: bytes) -> Iterator[bytes]:
    """Pieces of a text that end behind a separator."""
    at = 0
    while len(text) - at > PART and (m := _SEPARATOR.search(text, at + PART)):
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


def _long(scanner: Scanner, text: bytes) -> tuple[int, list[tuple[int, int, int]]]:
    """Number of words and the spans of a long text, read by parts; a match that begins in one part may end in the next."""
    n, found, ahead = 0, [], b""
    for piece in parts(text):
        whole = ahead + piece
        w = Words([whole], SEPARATORS)
        m = len(w.start)
        keep = max(0, m - scanner.longest)  # words from here on are read again with the next part
        found += [(n + a, k, i) for _, a, k, i in scanner.spans(w) if a < keep]
        n += keep
        ahead = whole[int(w.start[keep]) :] if keep < m else b""
    w = Words([ahead], SEPARATORS)
    found += [(n + a, k, i) for _, a, k, i in scanner.spans(w)]
    return n + len(w.start), found


def summary(scanner: Scanner, n: int, spans: list[tuple[int, int, int]]) -> dict:
    base = [s for s in spans if scanner.automata[s[2]][1]]
    starts = [a for a, _, _ in base]
    covered, last = 0, 0
    for a, k, _ in sorted(spans):
        covered += max(0, a + k - max(a, last))
        last = max(last, a + k)
    names = lambda found: ",".join(sorted({scanner.automata[i][0] for _, _, i in found}))
    return {
        "n_words": n,
        "n_base": len(base),
        "first_word": min(starts, default=None),
        "last_word": max(starts, default=None),
        "base_labels": names(base),
        "labels": names(spans),
        "score": covered / n if n else 0.0,
        "spans": [(scanner.automata[i][0], a, k, scanner.automata[i][1]) for a, k, i in sorted(spans)],
    }


COLUMNS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, word: long, words: long, base: boolean>>"


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, list[str]] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score and spans of every document.

    n_base counts the places of the phrases, first_word and last_word are the smallest and largest of
    them (null if there are none). labels are those of phrases and templates, score is the share of the
    text's words that stand in license wording, spans are its places.
    """
    scanner = Scanner(TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases)
    kind = docs.schema[key].dataType.simpleString()
    arrow_batches(docs.sparkSession)

    def run(batches):
        for pdf in batches:
            rows, group, size = [], [], 0
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in pdf["text"]]

            def flush(group):
                w = Words(group, SEPARATORS)
                spans = [[] for _ in group]
                for t, a, k, i in scanner.spans(w):
                    spans[t].append((a, k, i))
                return [summary(scanner, int(n), s) for n, s in zip(np.diff(w.offsets), spans, strict=True)]

            for b in texts:
                if group and size + len(b) > 1 << 20:
                    rows += flush(group)
                    group, size = [], 0
                if len(b) > PART:
                    rows += flush(group) if group else []
                    group, size = [], 0
                    rows.append(summary(scanner, *_long(scanner, b)))
                else:
                    group.append(b)
                    size += len(b) + 1
            rows += flush(group) if group else []
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in COLUMNS.split(", ")[:8]])
            out["first_word"], out["last_word"] = out["first_word"].astype("Int64"), out["last_word"].astype("Int64")
            out.insert(0, "key", pdf["key"].array)
            yield out

    found = docs.selectExpr(f"`{key}` as key", f"`{text}` as text").mapInPandas(run, f"key {kind}, {COLUMNS}")
    return found.withColumnRenamed("key", key)
