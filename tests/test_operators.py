"""Boundary rows of single operators, as literals."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from proofline.functions import exact as X
from proofline.operators import audit, checks, chunking, layout, quality, retrieval, rules, scoring, selection, store
from proofline.streaming import events as E

READING = "doc_id string, cml_id string, equipment_tag string, previous_mm string, current_mm string, min_required_mm string, review_status string"


@pytest.fixture()
def readings(spark):
    data = [
        ("a", "1", "T-1", "12.0", "11.32", "12.00", "accepted"),
        ("a", "2", "T-1", "9.0", "12.00", "12.00", None),
        ("a", "3", "T-1", "9.0", None, "12.00", "accepted"),
        ("a", "4", None, "9.0", "8.00", None, "accepted"),
        ("a", "5", "T-2", "9.0", None, None, "accepted"),
        ("b", "1", "T-3", "9.0", "l2.32", "12.00", "accepted"),
        ("b", "2", "T-3", "9.0", "8.0", "12.00", "needs review"),
        ("b", "3", "T-3", "9.0", "8.0", "12.00", "entered by X"),
    ]
    return spark.createDataFrame(data, READING)


def test_below_minimum_is_strict_and_skips_nulls_and_held_rows(readings):
    got = [(r.doc_id, r.cml_id, str(r.shortfall_mm)) for r in store.in_order(store.below_minimum(readings), "shortfall_mm").collect()]
    assert got == [("b", "3", "4.000000"), ("a", "1", "0.680000")]
    assert store.below_minimum(readings, include_unreviewed=True).count() == 3
    assert store.held_count(readings).first()[0] == 1
    assert store.held_count(readings, include_unreviewed=True).first()[0] == 0


def test_grew(readings):
    assert [(r.doc_id, r.cml_id) for r in store.thickness_grew(readings).collect()] == [("a", "2")]


def test_empty_store(spark):
    empty = spark.createDataFrame([], READING)
    assert store.below_minimum(empty).count() == 0
    assert store.held_count(empty).first()[0] == 0


def test_clause_with_hyphen_and_space(spark):
    f = spark.createDataFrame([("a", "F1", "Major", "T-1", "OISD-STD-118 Cl. 6.2"), ("a", "F2", "minor", None, "API 570 Cl 7")], "doc_id string, finding_id string, severity string, equipment_tag string, ref_clause string")
    assert [r.finding_id for r in store.find_findings(f, clause="std 118 cl 6.2").collect()] == ["F1"]
    assert [r.finding_id for r in store.find_findings(f, severity="MINOR").collect()] == ["F2"]


def test_replace_by_key(spark):
    old, new = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "doc_id int, v string"), spark.createDataFrame([(1, "n"), (3, "m")], "doc_id int, v string")
    assert sorted(map(tuple, store.replace_by_key(old, new).collect())) == [(1, "n"), (2, "z"), (3, "m")]


def test_ingest_replaces_partitions(spark, tmp_path):
    path = f"file://{tmp_path}/readings"
    store.ingest(spark.createDataFrame([(1, "x"), (2, "z")], "doc_id int, v string"), path)
    store.ingest(spark.createDataFrame([(1, "n")], "doc_id int, v string"), path)
    assert sorted((r.doc_id, r.v) for r in spark.read.parquet(path).collect()) == [(1, "n"), (2, "z")]


def test_rules(spark, readings):
    f = spark.createDataFrame([("a", "F1", "Major"), ("b", "F2", "Majr"), ("c", "F3", "Minor"), ("d", "F4", None)], "doc_id string, finding_id string, severity string")
    fired = rules.triggers(readings, f)
    got = sorted((r.doc_id, r.subject, r.rule_id, r.why) for r in fired.collect())
    assert ("a", "3", "EVD-01", "current missing") in got and ("a", "4", "EVD-01", "minimum missing") in got and ("a", "5", "EVD-01", "current missing") in got
    assert ("a", "F1", "SEV-01", "Major") in got and ("b", "F2", "EVD-01", "grade not read") in got and ("d", "F4", "EVD-01", "grade not read") in got
    assert not any(x[:2] == ("a", "2") for x in got)
    reports = spark.createDataFrame([(x,) for x in "abcde"], "doc_id string")
    outcome = {r.doc_id: r.outcome for r in rules.outcomes(reports, fired).collect()}
    assert outcome == {"a": "ESCALATE", "b": "ESCALATE", "c": "NO TRIGGER", "d": "NEEDS REVIEW", "e": "NO TRIGGER"}
    gate = {r.doc_id: r.reason for r in rules.gate(reports, readings, f).collect()}
    assert gate["b"] == "values need a person" and gate["d"] == "grade not read" and gate["c"] == "table not read" and gate["e"] == "table not read" and gate["a"] is None


@pytest.mark.parametrize(("values", "rate", "life"), [(("12", "11", "4", "9"), "0.250", "8.0"), (("10", "10", "4", "9"), "0.000", None), (("10", "11", "4", "9"), "-0.250", None), (("10", "9", "4", "9"), "0.250", "0.0"), (("10", "8", "4", "9"), "0.500", "0.0"), (("9", "9", "4", "9"), "0.000", "0.0")])
def test_remaining_life(spark, values, rate, life):
    row = rules.remaining_life(spark.createDataFrame([values], "previous_mm string, current_mm string, years string, min_required_mm string")).first()
    assert (str(row.corrosion_rate_mm_yr), row.remaining_life_yr and str(row.remaining_life_yr) or (None if row.remaining_life_yr is None else "0.0")) == (rate, life)


def test_remaining_life_needs_years(spark):
    with pytest.raises(Exception, match="years must be positive"):
        rules.remaining_life(spark.createDataFrame([("1", "1", "0", "1")], "previous_mm string, current_mm string, years string, min_required_mm string")).collect()


@pytest.mark.parametrize(("last", "life", "most", "due"), [("2024-02-29", 6.0, 5, "2027-02-28"), ("2024-02-29", 8.5, 9, "2028-02-29"), ("2026-02-03", 7.9, 5, "2029-02-03"), ("2026-02-03", 30.0, 5, "2031-02-03"), ("2026-02-03", 0.5, 5, "2027-02-03"), ("2026-02-03", 0.0, 5, "2026-02-03")])
def test_next_due(spark, last, life, most, due):
    rows = spark.createDataFrame([(dt.date.fromisoformat(last), life, most)], "last_inspection date, remaining_life_yr double, max_interval_yr int")
    assert str(rules.next_due(rows).first().next_due) == due


def test_exact_numbers_and_dates(spark):
    rows = spark.createDataFrame([(x,) for x in (" 12.30 ", "12.3 mm", "1e3", "12,3", "l2.3", "-4", None)], "s string")
    got = [(str(r[0]) if r[0] is not None else None, r[1]) for r in rows.select(X.exact(F.col("s")), X.printed_decimals(F.col("s"))).collect()]
    assert got == [("12.300000", 2), (None, None), (None, None), (None, None), (None, None), ("-4.000000", 0), (None, None)]
    dates = spark.createDataFrame([(x,) for x in ("31-02-2026", "3-2-2026", "29-02-2024", "x")], "s string").select(X.iso_date(F.col("s"))).collect()
    assert [str(r[0]) if r[0] else None for r in dates] == [None, "2026-02-03", "2024-02-29", None]


def test_whole_token_names(spark):
    texts = spark.createDataFrame([("see R-2247.",), ("see R-22470",), ("xR-2247",), ("r-2247-a",), ("R-2247",)], "text string")
    names = spark.createDataFrame([("R-2247",)], "name string")
    assert sorted(r.text for r in selection.named(texts, names).collect()) == ["R-2247", "see R-2247."]


def test_precision_outliers(spark):
    data = [("x", i, v) for i, v in enumerate(["1.10", "1.20", "1.3", "1.40"])] + [("y", i, v) for i, v in enumerate(["1.10", "1.2", "1.30"])] + [("z", i, v) for i, v in enumerate(["1.10", "1.20", "1.3", "1.4"])]
    got = quality.precision_outliers(spark.createDataFrame(data, "c string, i int, v string"), ["c"], "v", ["i"]).collect()
    assert [(r.c, r.v) for r in got] == [("x", "1.3")]


def test_closest_word(spark):
    words = spark.createDataFrame([(w,) for w in ("obseryation", "minreg", "location", "xyz", "locat")], "word string")
    choices = spark.createDataFrame([(w,) for w in ("observation", "minreq", "location")], "choice string")
    got = {r.word: (r.choice, r.how) for r in quality.closest(words, choices).collect()}
    assert got == {"obseryation": ("observation", "alike"), "minreg": ("minreq", "one edit"), "location": ("location", "exact")}


def test_chunks_rejoin_and_respect_the_limit(spark):
    texts = ["\n".join("x" * n for n in (700, 699, 1, 1500, 3)), "", "one", "a\n\nb"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in chunking.chunks(docs).orderBy("doc_id", "chunk").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    for i, t in enumerate(texts):
        if t:
            assert "\n".join(got[i]) == t
            assert all(len(c) <= 1400 or "\n" not in c for c in got[i])
    assert 1 not in got


def test_chain_finds_any_altered_line_but_the_last(spark):
    rows = spark.createDataFrame([("l", i, f'{{"e":{i}}}') for i in range(6)], "log string, n int, p string")
    good = audit.chain(rows, "log", "n", F.col("p"))
    assert audit.breaks(good, "log", "n").first().broken_at is None
    for i in range(5):
        bad = good.withColumn("line", F.when(F.col("n") == i, '{"e":99}').otherwise(F.col("line")))
        assert audit.breaks(bad, "log", "n").first().broken_at == i + 2
    last = good.withColumn("line", F.when(F.col("n") == 5, '{"e":99}').otherwise(F.col("line")))
    assert audit.breaks(last, "log", "n").first().broken_at is None


def test_scorer_mutations(spark):
    want = spark.createDataFrame([(1, "v", "12.32"), (1, "t", "North — side"), (2, "v", None), (3, "v", "1.0")], "id int, field string, value string")
    got = spark.createDataFrame([(1, "v", "12.320", False), (1, "t", "north - side", False), (2, "v", "3", True), (4, "v", "1", False)], "id int, field string, value string, flagged boolean")
    assert sorted((r.id, r.field, r.verdict) for r in scoring.field_score(got, want, ["id"]).collect()) == [(1, "t", "right"), (1, "v", "right"), (2, "v", "caught"), (3, "v", "missing"), (4, "v", "extra")]
    swapped = got.withColumn("value", F.when(F.col("id") == 1, "12.23").otherwise(F.col("value")))
    assert scoring.field_score(swapped, want, ["id"]).filter("verdict = 'wrong'").count() == 2


def test_leaks(spark):
    rows = spark.createDataFrame([("per OISD-STD-118 and R-2247",), ("only ASME-STD-570",), ("mail a.b@c.de from 10.0.0.1",), ("ABC/INSP/2026/12",)], "text string")
    got = [r[0] for r in rows.select(checks.leaks(F.col("text"), ("acme works",))).collect()]
    assert got == [["tag: R-2247"], [], ["e-mail: a.b@c.de", "private address: 10.0.0.1"], ["report number: ABC/INSP/2026/12"]]


def test_one_point_gives_no_slope(spark):
    items = spark.createDataFrame([(1, 0.0, 10.0, 10.0, 20.0)], "page int, x0 double, y0 double, x1 double, y1 double")
    one = spark.createDataFrame([(1, 5.0, 3.0)], "page int, x double, y double")
    assert layout.straightened(items, one, "page").first().y == 15.0
    assert layout.straightened(items, one.filter("false"), "page").first().y == 15.0


def test_bm25_needs_no_words(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta beta"), (3, "")], "doc_id int, text string")
    q = spark.createDataFrame([(1, "beta a"), (2, "nothing")], "query_id int, query string")
    got = retrieval.bm25(docs, q).collect()
    assert {(r.query_id, r.doc_id) for r in got} == {(1, 1), (1, 2)}


def test_too_many_queries_fail_rather_than_being_cut(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id int, embedding array<double>")
    q = spark.range(1001).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("v"))
    with pytest.raises(ValueError, match="batches"):
        retrieval.cosine_top(e, q)


def test_stream_equals_batch(spark, tmp_path):
    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(src)
    E.run_once(E.stream_daily(E.read_stream(spark, src, events.schema)), out, f"file://{tmp_path}/cp")
    batch = {(r.day, r.event_type): r.n for r in E.daily(E.with_event_time(events)).collect()}
    stream = {(r.day, r.event_type): r.n for r in spark.read.parquet(out).collect()}
    last = max(d for d, _ in batch)
    assert stream == {k: v for k, v in batch.items() if k[0] < last}  # the newest window stays open


def test_fuzzy_match_against_the_rule_written_out(spark):
    """Every word of the smallest tables, and some near misses, matched in plain Python."""
    from difflib import SequenceMatcher

    from proofline.operators import quality
    from proofline.plans import evidence

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    words = {r.word for r in evidence.benchmark_words(spark, "/root/testdata/sf0.001").collect()} | {"there", "ther", "theree", "natoin", "nations", "inter", "enter", "thong", "x"}
    listed = [r.choice for r in evidence.choices(spark).collect()]
    want = set()
    for w in words:
        scored = sorted(((1.0 if w == c else SequenceMatcher(None, w, c).ratio(), c) for c in listed), reverse=True)
        (best, choice), (second, _) = scored[:2]
        if w == choice:
            want.add((w, choice, "exact"))
        elif best - second >= 0.04 and (best >= 0.88 or (len(w) >= 5 and distance(w, choice) <= 1)):
            want.add((w, choice, "alike" if best >= 0.88 else "one edit"))
    got = quality.closest(spark.createDataFrame([(w,) for w in sorted(words)], "word string"), evidence.choices(spark))
    assert {tuple(r) for r in got.select("word", "choice", "how").collect()} == want and len(want) > 3


def test_worn_labels_come_after_clean_ones(spark):
    box = lambda i, text, x, y: (1, i, text, float(x), float(y), x + 50.0, y + 10.0)
    items = spark.createDataFrame(
        [box(1, "Unlt Name", 0, 0), box(2, "worn", 60, 0), box(3, "Unit Name:", 0, 20), box(4, "A", 60, 22), box(5, "B", 112, 21), box(6, "C", 300, 20), box(7, "Rep0rt No", 0, 40), box(8, "Report Mo", 0, 60), box(9, "x", 60, 60)],
        "page int, id int, text string, x0 double, y0 double, x1 double, y1 double",
    )
    labels = spark.createDataFrame([("Unit Name", "unit"), ("Report No.", "report")], "text string, label string")
    got = {r.label: r.value for r in layout.label_values(items, labels, "page").collect()}
    assert got == {"unit": "A B", "report": None}
    assert layout.label_values(items.limit(0), labels, "page").count() == 0


def test_labels_as_like_as_each_other_are_left(spark):
    items = spark.createDataFrame([(1, 1, "Plant Name A", 0.0, 0.0, 9.0, 9.0), (1, 2, "v", 10.0, 0.0, 19.0, 9.0)], "page int, id int, text string, x0 double, y0 double, x1 double, y1 double")
    labels = spark.createDataFrame([("Plant Name B", "b"), ("Plant Name C", "c")], "text string, label string")
    assert layout.label_values(items, labels, "page").count() == 0


def test_a_label_read_twice_at_one_place_gives_its_value_once(spark, monkeypatch):
    items = spark.createDataFrame([(1, i, t, x, 10.0, x + 30, 20.0) for i, t, x in ((1, "Unit:", 0.0), (1, "Unit:", 0.0), (2, "B-7", 40.0), (3, "Rep0rt No", 80.0), (4, "9", 120.0))] + [(None, 5, "Unit", 0.0, 10.0, 30.0, 20.0)], "page int, id int, text string, x0 double, y0 double, x1 double, y1 double")
    labels = spark.createDataFrame([("Unit", "unit"), ("Report No", "report_no")], "text string, label string")
    for few in (10_000, 0):  # texts with claims sent to every task, and met by a shuffle
        monkeypatch.setattr(layout, "FEW_TEXTS", few)
        assert sorted(map(tuple, layout.label_values(items, labels, "page").collect())) == [(1, "report_no", "9"), (1, "unit", "B-7")]


def test_note_without_anything(spark):
    notes = spark.createDataFrame([(1, None, None, None, None, "reject")], "doc_id int, header string, body string, cells string, signoff array<string>, outcome string")
    rows = spark.createDataFrame([], "doc_id int, cml_id string, current string, minimum string, status string")
    readings = spark.createDataFrame([(1, "c", "1:c", "9.0", None, None)], "doc_id int, cml_id string, evidence_id string, current string, minimum string, breached boolean")
    found = spark.createDataFrame([], "doc_id int, finding_id string, severity string, evidence_id string")
    got = {r.check: r.ok for r in scoring.note_checks(notes, rows, readings, found.drop("evidence_id"), found).collect()}
    assert got == {"row": False, "banner": False, "outcome": False, "findings": True, "ids": False, "placeholders": True, "sign-off": False}


def test_page_score_of_nothing_read(spark):
    truth = spark.createDataFrame([(1, "header", "", "unit", None, False), (1, "reading", "1", "location", "a", False), (1, "reading", "1", "current_mm", "9.10", True), (1, "finding", "F", "severity", "Major", False)], "doc_id int, part string, row string, field string, value string, number boolean")
    got = truth.drop("number").limit(0)
    r = scoring.page_score(got, truth).first()
    assert (r.fields, r.errors, r.critical_fields, r.critical_errors) == (4, 2, 3, 2)


def test_numbers_as_printed(spark):
    df = spark.createDataFrame([("20.0",), ("12.30 mm",), ("-5",), ("100",), ("n/a",), (None,)], "t string")
    assert [r[0] for r in df.select(scoring.number_as_printed(F.col("t"))).collect()] == ["20", "12.3", "-5", "100", "?n/a", ""]
