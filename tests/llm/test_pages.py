"""Page texts against hand-marked articles: with and without names, with and without the wrapper."""

import random
import re

import pyarrow.parquet as pq
import pytest

from proofline.llm import wrappers

TAGS = {"nav": "c1", "article": "c2", "footer": "c3"}


def nameless(page):
    """The page with its naming tags as plain div elements and no class."""
    for tag in TAGS:
        page = re.sub(rf"<(/?){tag}\b", r"<\1div", page)
    return re.sub(r' class=("[^"]*"|[^ >]*)', "", page)


def renamed(page):
    """The page with other class names, and its naming tags as div elements with such."""
    names = {}
    for tag, name in TAGS.items():
        page = re.sub(rf"<{tag}\b", f"<div class={name}", page).replace(f"</{tag}>", "</div>")
    return re.sub(r"class=([a-z][a-z-]*)", lambda m: "class=" + names.setdefault(m[1], f"c{len(names) + 9}"), page)


def site(pages=40):
    """(page, hand-marked text) of a site whose article, menu, notice, teasers and foot are marked by class alone."""
    r = random.Random(12)
    words = lambda a, b: " ".join(r.choice("river stone light under carry seven window paper slow green".split()) for _ in range(r.randrange(a, b)))
    out = []
    for i in range(pages):
        title, body = f"{words(2, 6)} {i}", [f"{words(1, 40)} {i}.{k}" for k in range(r.randrange(1, 7))]
        blocks = [f"<p>{x}</p>" for x in body]
        if i % 3:
            blocks.insert(len(blocks) // 2, "<div class=newsletter><p>Tell us where to send our letter</p></div>")
        menu = "".join(f"<li><a href=/{k}>{words(1, 3)}</a></li>" for k in range(r.randrange(2, 9)))
        more = "".join(f"<li><a href=/m{k}>{words(3, 9)}</a></li>" for k in range(r.randrange(0, 5)))
        out.append(
            (
                f"<html><body><div class=menu><ul>{menu}</ul></div><div class=cookie-notice><p>We keep what you tell us</p></div>"
                f"<div class=page><div class=content><h1>{title}</h1>{''.join(blocks)}</div><div class=related><ul>{more}</ul></div></div><div class=foot>© the site, all of it</div></body></html>",
                "\n".join([title, *body]),
            )
        )
    return out


def recall(got, want):
    return sum(a == b for a, b in zip(got, want, strict=True)) / len(want)


@pytest.mark.parametrize("change", [lambda p: p, renamed])
def test_marked_articles(change):
    pages, want = [change(p) for p, _ in site()], [t for _, t in site()]
    wrapper = wrappers.Wrapper(wrappers.infer(pages))
    assert recall([wrapper.read(p) for p in pages], want) == 1


def test_the_wrapper_decides():
    """Without names the host's wrapper still finds every article; a page on its own does not."""
    pages, want = [renamed(p) for p, _ in site()], [t for _, t in site()]
    plain = wrappers.Wrapper(wrappers.Part("#page"))
    assert recall([plain.read(p) for p in pages], want) < 0.5


def test_fixed_texts_go_inside_a_named_article():
    page = "<article><h1>Story {0}</h1><p>The first of {0}</p><div class=c4>Tell a friend</div><p>The last of {0}</p></article>".format
    pages = [page(i) for i in range(20)]
    assert wrappers.Wrapper(wrappers.infer(pages)).read(pages[3]) == "Story 3\nThe first of 3\nThe last of 3"
    same = ["<article><h1>A</h1><p>All of it</p></article><p>" + "x" * i + "</p>" for i in range(1, 9)]  # nothing but fixed text
    assert wrappers.Wrapper(wrappers.infer(same)).read(same[0]) == "A\nAll of it"


def test_heading_beside_the_text():
    page = "<body><div class=c1><ul><li><a>m{0}</a></ul></div><div class=c2><h1>Story {0}</h1><div class=c3><p>The first of {0} and more</p><p>The last of {0} and more</p></div></div></body>".format
    pages = [page(i) for i in range(9)]
    assert wrappers.Wrapper(wrappers.infer(pages)).read(pages[4]) == "Story 4\nThe first of 4 and more\nThe last of 4 and more"


def test_tables_without_names():
    """All pages of the smallest tables, by host: texts are the same where nothing is named."""
    by_host = {}
    for row in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist():
        by_host.setdefault(re.sub(r"^https?://([^/]*).*", r"\1", row["url"] or ""), []).append(row["html"] or "")
    same = total = alone = 0
    for pages in by_host.values():
        if len(pages) < wrappers.AGREE:
            continue
        named, bare = wrappers.Wrapper(wrappers.infer(pages)), wrappers.Wrapper(wrappers.infer(list(map(nameless, pages))))
        own = wrappers.Wrapper(wrappers.Part("#page"))
        for p in pages:
            text = named.read(p)
            same, alone, total = same + (bare.read(nameless(p)) == text), alone + (own.read(nameless(p)) == text), total + 1
    assert total > 150 and same / total > 0.95 and alone / total < 0.5, (same, alone, total)


def test_wrappers_meet_pages_by_a_shuffle(spark, monkeypatch):
    pages = [(i % 7 if i else None, f"http://h{i % 3}.example/{i}", p, "x", True, 5) for i, (p, _) in enumerate(site(30))] + [(5, "http://h9.example/", None, "y", False, 1)] * 2
    table = spark.createDataFrame(pages, "page_id long, url string, html string, wrapper string, page boolean, salt int").repartition(4)
    first = sorted(map(tuple, wrappers.extract(table).collect()), key=str)
    monkeypatch.setattr(wrappers, "SEND", -1)
    assert sorted(map(tuple, wrappers.extract(table).collect()), key=str) == first
    assert sorted(r[2] for r in first) == sorted([t for _, t in site(30)] + ["", ""])
