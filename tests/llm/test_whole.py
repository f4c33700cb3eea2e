"""The whole job: cases that an earlier version of an operator left out."""

import json

import pytest
from pyspark.sql import functions as F

from proofline.llm import licences, quality, wrappers


def test_wrapper_rests_on_all_pages():
    page = "<body><div><p>story {0} is long enough to matter</p>{1}</div></body>".format
    section = lambda i: "<section><p>Written by the desk</p></section>" if i < 3 else f"<section><p>Signed {i}</p></section>"
    pages = [page(f"{i:03}", section(i) if i < 3 or i > 30 else "") for i in range(40)]
    assert "Written by the desk" in wrappers.Wrapper(wrappers.infer(pages)).read(pages[0])
    rare = [page(f"{i:03}", "<ul><li>Tell a friend</li></ul>" if i > 30 else "") for i in range(40)]
    assert wrappers.Wrapper(wrappers.infer(rare)).read(rare[39]) == "story 039 is long enough to matter"


def test_wrappers_learn_from_each_page_once(spark):
    page = "<body><div><p>story {0} is long enough to matter</p>{1}</div></body>".format
    html = [page(f"{i:03}", "<ul><li>Tell a friend</li></ul>" if i > 57 else "") for i in range(60)]
    rows = [(i, "http://h.example/", p) for i, p in enumerate([*html, *[html[58]] * 5, page("060", "<ul><li>Tell a friend</li></ul>")])]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    found = wrappers.Part.load(json.loads(wrappers.learn(table.withColumn("host", F.lit("h.example"))).first().wrapper))
    assert found.seen == 61
    got = {r.page_id: r.text for r in wrappers.extract(table).collect()}
    assert got[65] == "story 060 is long enough to matter" and len(got) == 66


def test_article_in_several_siblings():
    plain = wrappers.Wrapper(wrappers.Part("#page"))
    page = "<body><div class='content'><p>first {0}</p></div><div class='content'><p>second and longer {0}</p></div><div class='content' id='comments'><p>me too</p></div></body>".format
    assert plain.read(page(1)) == "first 1\nsecond and longer 1"
    wrapper = wrappers.Wrapper(wrappers.infer([page(i) for i in range(5)]))
    assert wrapper.read(page(2)) == "first 2\nsecond and longer 2"
    split = "<main><article><p>one</p></article><nav>n</nav><article><p>two</p></article></main>"
    assert plain.read(split) == "one\ntwo"


@pytest.mark.parametrize(
    "page",
    [
        "<body><div class=menu>m</div><article class='post has-sidebar'><p>{}</p></article></body>",
        "<body><article class='post comments-open'><p>{}</p><div class=comments><p>me too, and at length</p></div></article></body>",
        "<body><div id=page class='no-sidebar'><ul class=nav><li>m</ul><main><p>{}</p></main></div></body>",
        "<body><form><div class=content><p>{}</p></div><input></form></body>",
        "<body><form><nav>m</nav><div><h1>{}</h1></div></form></body>",
    ],
)
def test_words_and_forms_around_the_article(page):
    plain = wrappers.Wrapper(wrappers.Part("#page"))
    assert plain.read(page.format("The story")) == "The story"
    wrapper = wrappers.Wrapper(wrappers.infer([page.format(f"The story {i}") for i in range(5)]))
    assert wrapper.read(page.format("The story 3")) == "The story 3"


def test_words_still_mark_what_is_not_the_article():
    plain = wrappers.Wrapper(wrappers.Part("#page"))
    assert plain.read("<body><div class='cookie-notice'><p>We use cookies</p></div></body>") == ""
    assert plain.read("<article><p>one</p></article><div class=comments><article><p>a long comment</p></article></div><form><p>find</p></form>") == "one"


def test_licences_inside_longer_places(spark):
    text = lambda name: (licences.TEXTS / f"{name}.txt").read_text()
    filler = " ".join(f"word{i} of the software" for i in range(200))
    texts = {
        1: "Copyright (c) 2020 Jane Doe. Released under the MIT License.",
        2: "This project is released under the MIT License, see the file LICENSE.",
        3: f"{filler} {text('MIT')} {filler}",
        4: text("Apache-2.0"),
        5: f"{filler}\n\n{text('GPL-3.0')}\n\n{filler}",
        6: f"{filler}. Released under the ISC License. {filler}. Released under the ISC License. {filler}",
        7: filler,
        8: text("BSD-3-Clause"),
        9: f"Released under the MIT License.\n{filler}",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {}
    for r in licences.scan(docs).collect():
        got.setdefault(r.doc_id, {})[r.licence] = (round(r.dice, 2), r.n_places)
    assert got[1] == got[2] == got[9] == {"MIT": (1.0, 1)}
    assert got[6] == {"ISC": (1.0, 2)}
    for i, name in ((3, "MIT"), (4, "Apache-2.0"), (5, "GPL-3.0"), (8, "BSD-3-Clause")):
        assert got[i][name][0] == 1.0, (i, got[i])
    assert 7 not in got and set(got[3]) == {"MIT"} and set(got[8]) == {"BSD-3-Clause"}


def test_all_documents_stay_without_both_classes(spark, docs):
    labels = spark.createDataFrame([(0, 1), (3, 1)], "doc_id long, quality int")
    for some in (labels, labels.filter("false")):
        kept = quality.keep_good(docs, some)
        assert kept.count() == docs.count() and kept.columns == docs.columns
