"""Pages whose markup names nothing: the host's slots decide; each page by itself would not do. Odd ends and names."""

import collections
import random
import re

import pytest

from quillon.llm import wrapper

PAGES = "page_id long, url string, html string"


def plain(html):
    """Without names, roles and telling elements."""
    html = re.sub(r'\s(class|id|role|itemprop)="[^"]*"', "", html)
    return re.sub(r"<(/?)(article|main|nav|header|footer|aside|section|form)(?=[\s>])", r"<\1div", html)


def renamed(html, rnd):
    """With a random name in each class."""
    return re.sub(r"<(div|p|ul)(?=[\s>])", lambda m: f'<{m[1]} class="{"".join(rnd.choice("bcdfgkx") for _ in range(6))}{rnd.randrange(10**6)}"', plain(html))


@pytest.fixture(scope="module")
def pages(spark):
    return [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").collect()]


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in wrapper.articles(spark.createDataFrame(rows, PAGES)).collect()}


def f1(want, got):
    both = sizes = 0
    for i, t in want.items():
        a, b = collections.Counter(t.split()), collections.Counter(got[i].split())
        both += sum((a & b).values())
        sizes += sum(a.values()) + sum(b.values())
    return 2 * both / sizes


def test_neutral_and_random_names(spark, pages):
    want = texts(spark, pages)
    rnd = random.Random(1)
    assert f1(want, texts(spark, [(i, u, plain(h)) for i, u, h in pages])) >= 0.99
    assert f1(want, texts(spark, [(i, u, renamed(h, rnd)) for i, u, h in pages])) >= 0.99
    # each page as a host of its own: some ads and footers weigh more than short articles
    alone = texts(spark, [(i, f"https://h{i}.example/", plain(h)) for i, u, h in pages])
    assert sum(alone[i] != want[i] for i in want) >= 3


def test_text_after_a_sign_that_opens_no_tag():
    text = lambda h: [t for _, t, _ in wrapper.Page(h).blocks]
    assert text("<article><p>if a < b then stop") == ["if a < b then stop"] and text("<p>1 < 2 tail") == ["1 < 2 tail"]
    assert text("<p>end <a href='x") == ["end"] and text("<p>end <") == ["end"] and text("<p>a <!-- b") == ["a"]


def test_names_with_numbers_make_no_slots(spark):
    body = '<div class="entry-{0}x" id="n{0}"><p class="k{0}">Some words of page {0} that are as many as a sentence has.</p></div>'
    pages = spark.createDataFrame([(i, "https://a.example/", body.format(i)) for i in range(200)], PAGES)
    wrappers, stats = wrapper.infer(pages)
    assert stats.count() == 1 and len(wrappers.first()["wrapper"]) < 100
