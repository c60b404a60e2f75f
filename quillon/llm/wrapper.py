"""Main text of web pages by wrappers: union-free regular expressions inferred per host.

A page is read as a stream of block tags and text slots. Streams of one host are aligned one
after the other: equal neighbouring runs fold into repeated groups, runs that only one side
has become optional groups, and texts become slots. Each slot of the wrapper (the path of
block elements it stands under) gets statistics over all pages of the host; the slots of the
article are kept: those under article or main elements, else under containers named as
content, else slots whose text varies from page to page, holds prose and few links, and stands in
the container that has most of the host's prose. Names of elements count as far as they are known
words; others, of which there may be as many as pages, are no part of a slot. Slots of
menus, headers, footers, sidebars, notices, adverts, forms and comments never count, nor
scripts, styles, comments of the markup and hidden elements.

A page without any slot of its host's wrapper is judged by its own slots; if none of them
holds prose either, all count that are neither boilerplate nor mostly links. Character
references are decoded, white space within and between blocks becomes one space. Null or
empty html gives an empty text; html of any length is read whole. Pages without a host share
the wrapper of the empty host; repeated rows get equal results; extra columns are ignored.
There are no ties: slots are kept or not, and blocks keep the order of the page.
"""

from __future__ import annotations

import html as htmllib
import re
import zlib
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, stash

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template title head iframe object svg canvas math select option textarea button datalist audio video map".split())
BOILER = frozenset("nav header footer aside form menu dialog fieldset".split()) | UNSEEN
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup comment comments disqus reply replies respond sidebar rail widget related recommended recommendations share sharing social breadcrumb breadcrumbs menu nav navbar navigation footer header masthead toolbar pagination pager login search skip hidden".split()
)
ROLES = frozenset("navigation banner complementary contentinfo search form alert dialog menu menubar".split())
CONTENT_WORDS = frozenset("article articlebody story content post entry main maincontent".split())
KNOWN_WORDS = BOILER_WORDS | CONTENT_WORDS
#: Elements that an opening tag closes when they are open: the tag itself and its likes.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}}
BREAKS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
STOPS = {"li": {"ul", "ol", "menu"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "dt": {"dl"}, "dd": {"dl"}}
#: Skeletons or partial wrappers of a host that one task aligns.
FAN = 16
HEADING = re.compile(r">h[1-6]\b[^>]*$")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\s(?:\"[^\"]*\"|'[^']*'|[^'\">])*)?/?)>|<[!?][^>]*>", re.S | re.I)
_ATTR = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: A tag that the page breaks off in; a `<` before anything but a name is text.
_UNFINISHED = re.compile(r"<(?:[a-zA-Z/!?][^<>]*)?\Z")


def _segment(tag: str, attrs: str) -> str:
    """Tag and names of an element, then ! for boilerplate, * for an article root, + for a likely root."""
    names, mark, role = "", "", ""
    if attrs and ("=" in attrs or "hidden" in attrs):
        found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs)}
        names = " ".join(x for x in (found.get("class", ""), found.get("id", "")) if x)
        role = found.get("role", "").lower()
        if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
            mark = "!"
        if found.get("itemprop", "").lower() == "articlebody" or role in ("main", "article"):
            mark = mark or "*"
    words = {w.lower() for w in _NAME.findall(names)}
    bad = words & BOILER_WORDS
    if bad == {"header"} and words & CONTENT_WORDS:
        bad = set()
    if tag in BOILER or bad or role in ROLES:
        mark = "!"
    elif not mark:
        mark = "*" if tag in ("article", "main") else "+" if words & CONTENT_WORDS and tag in ("div", "section", "td") else ""
    known = words & KNOWN_WORDS  # other names may be as many as there are pages
    return tag + ("." + ".".join(sorted(known)) if known else "") + mark


class Page:
    """Blocks (path, text, letters within links) and the stream of block tags of one page."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, str, int]] = []
        self.stream: list[str] = []
        stack: list[tuple[str, str]] = []
        paths = [""]
        text: list[str] = []
        links = link_depth = 0

        def flush():
            nonlocal links
            if text:
                t = " ".join(htmllib.unescape("".join(text)).split())
                if t:
                    self.blocks.append((paths[-1], t, links))
                    self.stream.append("#")
                text.clear()
                links = 0

        def push(tag, segment):
            if tag == "header" and "*" in paths[-1]:
                segment = segment.replace("!", "")
            stack.append((tag, segment))
            paths.append(f"{paths[-1]}>{segment}")
            self.stream.append(segment)

        def pop():
            tag, _ = stack.pop()
            paths.pop()
            self.stream.append("/" + tag)

        at = 0
        for m in _TOKEN.finditer(source):
            start = m.start()
            if start > at:
                text.append(source[at:start])
                if link_depth:
                    links += start - at
            at = m.end()
            tag = m[3]
            if tag is None:
                if m[1]:
                    text.append(" ")
                continue
            tag = tag.lower()
            closing = m[2]
            if tag in INLINE:
                if tag == "a":
                    link_depth = 0 if closing else 1
                continue
            flush()
            link_depth = 0
            if closing:
                depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
                if depth >= 0:
                    while len(stack) > depth:
                        pop()
                continue
            if tag in VOID:
                continue
            if tag in BREAKS_P and stack and stack[-1][0] == "p":
                pop()
            if tag in CLOSES:
                closes, stops = CLOSES[tag], STOPS.get(tag, ())
                depth = -1
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in stops:
                        break
                    if stack[i][0] in closes and stack[i][0] == tag:
                        depth = i
                        break
                    if tag == "p":
                        break
                if depth >= 0:
                    while len(stack) > depth:
                        pop()
            if tag == "body":
                while stack and stack[-1][0] == "head":
                    pop()
            if tag in ("html", "body") and any(t == tag for t, _ in stack):
                continue
            push(tag, _segment(tag, m[4]))
        if at < len(source):
            text.append(_UNFINISHED.sub("", source[at:]))
        flush()
        while stack:
            pop()


# Wrapper nodes are tags, "#" for a text slot, ("+", body) for a repeated and ("?", body) for an optional group.
# A group closes what it opens and nothing else, so every slot keeps the path that it has in its pages.


def balanced(nodes) -> bool:
    """Whether a run closes each element that it opens, and no other."""
    depth = 0
    for n in nodes:
        if isinstance(n, str) and n != "#":
            depth += -1 if n.startswith("/") else 1
            if depth < 0:
                return False
    return depth == 0


def fold(nodes: list, longest: int = 40) -> list:
    """Adjacent equal runs become one repeated group, shortest periods first."""
    nodes = list(nodes)
    for period in range(1, longest + 1):
        out: list = []
        i = 0
        while i < len(nodes):
            body = nodes[i : i + period]
            k = i + period
            while len(body) == period and nodes[k : k + period] == body:
                k += period
            if k > i + period and balanced(body):
                group = ("+", tuple(body))
                if period == 1 and isinstance(body[0], tuple) and body[0][0] == "+":
                    group = body[0]
                if not (out and out[-1] == group):
                    out.append(group)
                i = k
            else:
                node = nodes[i]
                if out and isinstance(out[-1], tuple) and out[-1][0] == "+" and tuple(nodes[i : i + len(out[-1][1])]) == out[-1][1]:
                    i += len(out[-1][1])
                    continue
                out.append(node)
                i += 1
        nodes = out
        if period > len(nodes) // 2:
            break
    return nodes


def _items(nodes: list) -> list[list]:
    """The siblings of a balanced run: elements from tag to end tag, slots and groups."""
    out: list[list] = []
    depth = 0
    for n in nodes:
        if depth == 0:
            out.append([])
        out[-1].append(n)
        if isinstance(n, str) and n != "#":
            depth += -1 if n.startswith("/") else 1
    return out


class _Pair:
    """Children of two like elements, still to be aligned."""

    def __init__(self, a: list, b: list):
        self.a, self.b = a, b


def _siblings(a: list, b: list) -> list:
    """Nodes that cover both runs, with a pair in place of the children of elements that both have."""
    if a == b:
        return a
    left_items, right_items = _items(a), _items(b)
    out: list = []
    for op, i, j, k, m in SequenceMatcher(None, [x[0] for x in left_items], [x[0] for x in right_items], autojunk=False).get_opcodes():
        if op == "equal":
            for x, y in zip(left_items[i:j], right_items[k:m], strict=True):
                out += x if x == y else [x[0], _Pair(x[1:-1], y[1:-1]), x[-1]]
            continue
        left, right = [[n for x in side for n in x] for side in (left_items[i:j], right_items[k:m])]
        if len(left) == 1 and isinstance(left[0], tuple) and (not right or tuple(fold(right)) in (left[0][1], (left[0],))):
            out += left if right else [left[0] if left[0][0] == "?" else ("?", (left[0],))]
        elif len(right) == 1 and isinstance(right[0], tuple) and (not left or tuple(fold(left)) in (right[0][1], (right[0],))):
            out += right if left else [right[0] if right[0][0] == "?" else ("?", (right[0],))]
        else:
            for side in (left, right):
                if side:
                    group = side[0] if len(side) == 1 and isinstance(side[0], tuple) and side[0][0] == "?" else ("?", tuple(side))
                    if not (out and out[-1] == group):
                        out.append(group)
    return out


def align(a: list, b: list) -> list:
    """A wrapper of this kind that covers both: like elements are aligned within, mismatches become repeated or optional groups."""
    if a == b:
        return a
    out: list = []
    todo: list = [_Pair(a, b)]
    while todo:
        x = todo.pop()
        if isinstance(x, _Pair):
            todo += reversed(_siblings(x.a, x.b))
        else:
            out.append(x)
    return fold(out)


def slots(wrapper: list, path: str = "") -> set[str]:
    """Paths of the text slots of a wrapper."""
    found: set[str] = set()

    def walk(nodes, at: list[str]):
        for n in nodes:
            if isinstance(n, tuple):
                walk(n[1], list(at))
            elif n == "#":
                found.add("".join(">" + x for x in at))
            elif n.startswith("/"):
                if at:
                    at.pop()
            else:
                at.append(n)

    walk(wrapper, [x for x in path.split(">") if x])
    return found


def encode(nodes) -> str:
    """A wrapper as text: groups in brackets, tokens between blanks."""
    return " ".join(f"( {encode(n[1])} ){n[0]}" if isinstance(n, tuple) else n for n in nodes)


def decode(text: str) -> list:
    stack: list[list] = [[]]
    for t in text.split(" "):
        if t == "(":
            stack.append([])
        elif t in (")+", ")?"):
            body = tuple(stack.pop())
            stack[-1].append((t[1], body))
        elif t:
            stack[-1].append(t)
    return stack[0]


def host(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    parts = sorted(set(pdf["wrapper"]), key=lambda x: (len(x), x))
    wrapper = decode(parts[0])
    for p in parts[1:]:
        wrapper = align(wrapper, decode(p))
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "salt": [pdf["salt"].iloc[0]], "wrapper": [encode(wrapper)]})


def infer(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, wrapper) and (host, path, pages, blocks, words, link letters, letters, constant) over pages(url, html).

    Equal skeletons of a host count once; the others are aligned in a tree of salted parts, about
    FAN in each, so a host with a third of all pages does not meet in one task. Only the largest
    number of skeletons of a host reaches the driver. A slot is constant if all its texts are
    the same on every page.
    """
    arrow_batches(pages.sparkSession, 500)

    def run(batches):
        for p in batches:
            rows = []
            for h, source in zip(p["host"], p["html"], strict=True):
                page = Page(source or "")
                rows.append((h, encode(fold(page.stream)), None, 0, 0, 0, 0, None))
                stats: dict[str, list] = {}
                for path, t, links in page.blocks:
                    s = stats.setdefault(path, [0, 0, 0, 0, 0])
                    s[0] += 1
                    s[1] += t.count(" ") + 1
                    s[2] += links
                    s[3] += len(t)
                    s[4] = zlib.crc32(t.encode("utf-8", "surrogatepass") + b"\n", s[4])
                rows += [(h, None, path, *s) for path, s in stats.items()]
            yield pd.DataFrame(rows, columns=["host", "wrapper", "path", "blocks", "words", "links", "letters", "sample"])

    seen = pages.select(host().alias("host"), "html").mapInPandas(run, "host string, wrapper string, path string, blocks long, words long, links long, letters long, sample long")
    seen = seen.groupBy("host", "wrapper", "path").agg(F.count("*").alias("pages"), *[F.sum(c).alias(c) for c in ("blocks", "words", "links", "letters")], (F.min("sample") == F.max("sample")).alias("constant"))
    seen = stash(seen)
    skeletons = seen.where("wrapper is not null").select("host", "wrapper")
    most = skeletons.groupBy("host").count().agg(F.max("count")).first()[0] or 1
    parts = 1
    while parts * FAN < most:
        parts *= FAN
    wrappers = skeletons.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(parts)))
    while True:
        wrappers = wrappers.groupBy("host", "salt").applyInPandas(_merge, "host string, salt long, wrapper string")
        if parts == 1:
            break
        parts //= FAN
        wrappers = wrappers.withColumn("salt", F.floor(F.col("salt") / FAN).cast("long"))
    wrappers = wrappers.drop("salt")
    return wrappers, seen.where("path is not null").drop("wrapper")


def choose(paths: list[tuple[str, int, int, int, int, int, bool]]) -> list[str]:
    """Article slots of (path, pages, blocks, words, links, letters, constant)."""
    live = [p for p in paths if "!" not in p[0]]
    for mark in "*+":
        if rooted := [p[0] for p in live if mark in p[0]]:
            return rooted
    prose = [p for p in live if not (p[6] and p[1] >= 3) and 2 * p[4] < p[5]]
    dense = [p for p in prose if p[3] >= 8 * p[2]]
    if not dense:
        return []
    # the container whose slots hold most of the prose is the article; its other slots and headings belong to it
    mass: dict[str, int] = {}
    for p in dense:
        mass[_container(p[0])] = mass.get(_container(p[0]), 0) + p[5]
    root = max(sorted(mass), key=mass.__getitem__)
    inside = [p for p in prose if p[0].startswith(f"{root}>")]
    return sorted({p[0] for p in dense if p in inside} | {p[0] for p in inside if HEADING.search(p[0])})


def _container(path: str) -> str:
    """The element that a slot's own element stands in; lists and tables stand in what holds them."""
    parts = path.split(">")[:-1]
    while parts and re.match(r"(?:ul|ol|li|dl|dd|dt|table|tbody|thead|tr|td|blockquote)\b", parts[-1]):
        parts.pop()
    return ">".join(parts)


def articles(pages: DataFrame, broadcast_hosts: int = 20_000) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages(page_id, url, html, ...)."""
    wrappers, stats = infer(pages)
    stat = F.struct("path", "pages", "blocks", "words", "links", "letters", "constant")

    @F.pandas_udf("array<string>")
    def kept(wrapper: pd.Series, stats: pd.Series) -> pd.Series:
        out = []
        for w, s in zip(wrapper, stats, strict=True):
            known = slots(decode(w))
            rows = [tuple(x[k] for k in ("path", "pages", "blocks", "words", "links", "letters", "constant")) for x in s]
            inside = [r for r in rows if r[0] in known]
            out.append(choose(inside or rows))
        return pd.Series(out)

    chosen = wrappers.join(stats.groupBy("host").agg(F.collect_list(stat).alias("stats")), "host").select("host", kept("wrapper", "stats").alias("slots"))
    chosen = stash(chosen)
    if chosen.count() <= broadcast_hosts:
        chosen = F.broadcast(chosen)

    def run(batches):
        for p in batches:
            texts = []
            for source, keep in zip(p["html"], p["slots"], strict=True):
                blocks = Page(source or "").blocks
                keep = set(keep) if keep is not None else set()
                own = [t for path, t, _ in blocks if path in keep]
                if not own and blocks:
                    one: dict[str, list] = {}
                    for path, t, links in blocks:
                        s = one.setdefault(path, [path, 1, 0, 0, 0, 0, False])
                        s[2] += 1
                        s[3] += t.count(" ") + 1
                        s[4] += links
                        s[5] += len(t)
                    keep = set(choose([tuple(s) for s in one.values()])) or {s[0] for s in one.values() if "!" not in s[0] and 2 * s[4] < s[5]}
                    own = [t for path, t, _ in blocks if path in keep]
                texts.append(" ".join(own))
            yield pd.DataFrame({"page_id": p["page_id"], "url": p["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    rows = pages.select(F.col("page_id").cast("long"), "url", "html", host().alias("host")).join(chosen, "host", "left").drop("host")
    return rows.mapInPandas(run, "page_id long, url string, text string, n_chars long")
