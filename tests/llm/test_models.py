"""Quality, licences, neighbours, pages and the pipeline."""

import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest

from conftest import make  # noqa: F401
from proofline.llm import ann, licences, packing, quality, queries, wrappers

DATA = "/root/testdata/sf0.01"


def read(spark, name, at=DATA):
    return spark.read.parquet(f"{at}/{name}.parquet")


def test_quality_on_rows_held_out(spark):
    got = {r.doc_id: r for r in quality.classify(read(spark, "documents"), read(spark, "labels")).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in got.items())
    held = [(got[r.doc_id].predicted, r.quality) for r in read(spark, "labels").collect() if got[r.doc_id].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.95


def test_quality_of_odd_rows(spark, docs, empty):
    labels = spark.createDataFrame([(0, 1), (3, 0), (4, None), (999, 1), (None, 0), (5, 7)], "doc_id long, quality int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.classify(docs, labels.filter("quality = 1")).collect()} == {0.5}
    assert quality.classify(empty, labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_more_of_the_better_wins():
    r = np.random.default_rng(1)
    x = r.normal(size=(400, quality.FEATURES))
    better = x[:, 3] - x[:, 5] > 0
    model = quality.fit(x, better)
    assert ((model.score(x) >= 0.7) == better).mean() > 0.95


def test_licences_equal_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = con.sql(licences.oracle("documents"))
    assert sorted(map(tuple, licences.scan(read(spark, "documents")).collect())) == sorted(want.fetchall())


def test_licences_of_odd_rows(spark, docs, corpus, empty):
    got = {(r.doc_id, r.licence): (r.dice, r.n_places) for r in licences.scan(docs).collect()}
    by_text = {t: i for i, t in corpus}
    assert got[by_text["Licensed under the Apache License, Version 2.0."], "Apache-2.0"] == (1.0, 1)
    assert got[by_text["released   under the MIT license"], "MIT"] == (1.0, 1)
    assert sum(k[1] == "Proprietary" for k in got) == 1 and len(got) == 3
    assert licences.scan(empty).count() == 0
    none = spark.createDataFrame([], "licence string, text string")
    assert licences.scan(docs, none).count() == 0


def test_neighbours_equal_brute_force(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=16).tolist()) for i in range(300)]
    rows += [(300, rows[0][1]), (301, [2 * x for x in rows[0][1]]), (302, None), (303, [0.0] * 16), (304, [float("nan")] * 16), (305, [None] * 16), (306, [1.0] * 3), (307, [float("inf")] * 16), (308, [1e-200] * 16)]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, v string, query_id int").repartition(4)
    got = {}
    for x in ann.nearest(table, table.filter("vec_id % 50 = 0"), 5, query_bytes=500).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    keep = [(i, np.array(v)) for i, v in rows if i < 302 or i == 308]
    for q, v in keep:
        if q % 50 == 0:
            scores = [(-float(ann.cosine(v[None], w[None])[0]), i) for i, w in keep if i != q]
            assert [(n, i, s) for n, i, s in sorted(got[q])] == [(n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:5])]
    assert set(got) == {q for q, _ in keep if q % 50 == 0}
    assert ann.nearest(table.filter("false"), table.filter("false")).count() == 0
    assert ann.nearest(table.filter("vec_id in (0, 1, 2)"), table.filter("vec_id = 0")).count() == 2


PAGES = [
    ("<html><body><header><a>Home</a></header><div class='cookie-notice'>We use</div><main><h1>T</h1><p>One &amp; two<p>Three <b>b</b>old<form>x</form><section id=comments><p>c</p></section></main><footer>f</footer>", "T\nOne & two\nThree bold"),
    ("<div id=nav>m</div><div class=content><h2>A</h2><div class=ad>buy</div><ul><li>i1<li>i2</ul><table><tr><td>a<td>b</table></div>", "A\ni1\ni2\na\nb"),
    ("1 &lt; 2 and 3 < 4", "1 < 2 and 3 < 4"),
    ("<article><p>whole <i>text</i></p><script>var a='</p>';</script><p>breaks o&am", "whole text\nbreaks o&am"),
    ("<article><p>tag at the end</p><p", "tag at the end"),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_pages_on_their_own(page, text):
    assert wrappers.Wrapper(wrappers.Part("#page")).read(page) == text


def test_wrapper_learns_what_never_changes():
    page = "<body><div class='top'><p>Welcome to our site</p></div><div><p>{}</p><p>{}</p></div></body>".format
    pages = [page(f"story number {i} is long enough to matter", f"and its end {i}") for i in range(6)]
    wrapper = wrappers.Wrapper(wrappers.Part.load(wrappers.infer(pages).dump()))
    assert wrapper.read(pages[5]) == "story number 5 is long enough to matter\nand its end 5"


def test_pages_query(spark):
    rows = spark.createDataFrame([(i, f"http://h{i % 2}.example/{i}" if i != 3 else None, p, 1) for i, (p, _) in enumerate(PAGES)], "page_id long, url string, html string, host int")
    got = {r.page_id: (r.text, r.n_chars) for r in wrappers.extract(rows).collect()}
    assert got == {i: (t, len(t)) for i, (_, t) in enumerate(PAGES)}
    assert wrappers.extract(rows.filter("false")).count() == 0
    deep = wrappers.Wrapper(wrappers.Part("#page")).read("<div>" * 20_000 + "x")
    assert deep == "x"


def test_pages_of_the_tables(spark):
    got = wrappers.extract(read(spark, "pages", "/root/testdata/sf0.001")).toPandas()
    assert len(got) == 50 and (got.text.str.len() == got.n_chars).all() and not got.text.str.contains("<p>|&copy;|track\\(").any()


def test_pipeline_against_its_parts(spark, tmp_path):
    import corpus_pipeline
    from test_sets import brute_components, brute_repeats

    data = "/root/testdata/sf0.001"
    docs = read(spark, "documents", data)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "repeats", "packing"]
    good = corpus_pipeline.good_quality(spark, docs, data)
    scores = {r.doc_id: r.predicted for r in quality.classify(docs, read(spark, "labels", data)).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    left = [(i, t) for i, t in sorted(texts.items()) if scores[i]]
    assert good.columns == docs.columns and sorted(r.doc_id for r in good.collect()) == [i for i, _ in left]
    first = [(i, t) for i, t in left if brute_components(left, 5, 80, 100)[i][1] == i] if len(left) < 60 else None
    one = corpus_pipeline.one_of_each(spark, good, data)
    kept = sorted((r.doc_id, r.text) for r in one.collect())
    parts = brute_components(left, 5, 80, 100)
    assert [i for i, _ in kept] == [i for i, _ in left if parts[i][1] == i] and (first is None or len(first) == len(kept))
    cut = corpus_pipeline.without_repeats(spark, one, data)
    want = brute_repeats(kept, 100)
    assert cut.columns == docs.columns
    assert {r.doc_id for r in cut.collect()} == {i for i, t in kept if want[i][1] < want[i][0] or not t}
    rows = corpus_pipeline.run(spark, data).toPandas()
    again = packing.pack_documents(cut, public_tokenizers.path("byte_bpe_50k.json")).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    pd.testing.assert_frame_equal(rows[key].sort_values(key).reset_index(drop=True), again[key].sort_values(key).reset_index(drop=True))
    assert rows.groupby("sequence_id").length.sum().max() <= 2048


def test_every_operator_is_registered():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")] == list(range(1, 11))
