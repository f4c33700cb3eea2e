"""Rules of addresses, words, titles, headings and matches on single rows."""

import ipaddress
import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from proofline.operators import checks, chunking, layout, library, retrieval


def one(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_scopes_are_those_of_the_registries(spark):
    r = random.Random(5)
    some = [".".join(str(r.choice([0, 1, 10, 127, 169, 172, 192, 198, 203, 224, 240, 254, 255, 16, 31, 168, 18, 51, 100, 2, 113])) for _ in range(4)) for _ in range(600)]
    some += ["192.0.0.9", "192.0.0.10", "192.0.0.11", "::", "::1", "0:0:0:0:0:0:0:1", "0:0:0:0:0:0:0:0", "fe80::1", "febf::1", "fec0::1", "fc00::1", "fdff::2", "fe00::1", "2001:db8::1", "2002::1", "2a00:1450::1", "100::1", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "::ffff:127.0.0.1"]
    some += ["256.1.1.1", "1.2.3", "localhost", "", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", "*", "printer", "01.2.3.4", "12345::1", "g::1"]

    def want(a):
        try:
            ip = ipaddress.ip_address(a)
        except ValueError:
            return None
        if ip.is_unspecified:
            return None
        return "loopback" if ip.is_loopback else "local" if ip.is_private or ip.is_link_local else "external"

    got = {x.a: x.s for x in one(spark, [(a,) for a in some], "a string").select("a", checks.scope(F.col("a")).alias("s")).collect()}
    assert got == {a: want(a) for a in some}


def test_connections_of_a_listing(spark):
    text = "  TCP 1.1.1.1:5 [fe80::1%eth0]:443 SYN_SENT 12\r\n  TCP 0.0.0.0:1 0.0.0.0:0 LISTENING 4\n UDP 1.1.1.1:5 2.2.2.2:5 ESTABLISHED 4\nTCP 1.1.1.1:5 2.2.2.2:5 ESTABLISHED x\nTCP 1.1.1.1:5 2.2.2.2:5 ESTABLISHED 4 more\nTCP a b"
    found = one(spark, [(text,), (None,), ("",)], "t string").select(F.inline(checks.netstat(F.col("t")))).collect()
    assert [(x.remote, x.state, x.pid) for x in found] == [("fe80::1", "SYN_SENT", 12), ("2.2.2.2", "ESTABLISHED", 4)]


def test_names_are_no_ordinary_words(spark):
    rows = one(spark, [("The Panel said that panels of Oslo and e-mail1 are élan",), (None,)], "text string")
    assert {x.term for x in retrieval.vocabulary(rows).collect()} == {"said", "that", "panels", "of", "and", "e", "are"}


def test_titles_look_at_lines_that_hold_something(spark):
    rows = [("D-1", "12\n\n  \nD-1\nshort\nOK\nThe first line of all"), ("D-2", "1\n2\n3\n4\n5\nA title that is long enough"), ("D-3", ""), ("D-4", None), ("D-5", "one\ntwo\nthree\nfour\nA title that comes too late")]
    docs = one(spark, rows, "doc_id string, text string")
    got = {x.doc_id: x.title for x in chunking.titles(chunking.lines_of(docs)).collect()}
    assert got == {"D-1": "The first line of all", "D-2": "A title that is long enough", "D-3": "D-3", "D-5": "D-5"}


def test_type_makes_a_heading_where_bold_is_unknown(spark):
    rows = [(None, 10.9, 10.0), (None, 10.8, 10.0), (None, 10.7, 10.0), (True, 1.0, 10.0), (False, 20.0, 10.0), (None, 20.0, None)]
    got = [x.h for x in one(spark, rows, "b boolean, h double, y double").select(chunking.heading_type(F.col("b"), F.col("h"), F.col("y")).alias("h")).collect()]
    assert got == [True, True, False, True, False, False]


FORM = [("identification", "1equipmentidentification"), ("findings", "2inspectionfindings"), ("thickness", "3ultrasonicthicknesssurvey")]


def test_headings_may_be_worn_but_for_their_number(spark):
    texts = ["1. EQUIPMENT IDENTIFICATION", "2.INSPECTIONFINPINGS", "Ultrasonic Thickness Survey", "3. Ultrasonlc Thickness Survey", "2. Inspection findings of the plant", "2. Inspect", "3.", "2. Inspectian fandings and all of what follows", "4. Inspection findings", "2xnspxctxxnfindxngs", None]
    items = one(spark, [(1, 1, t, 10.0 * n, 10.0 * n + 5) for n, t in enumerate(texts)], "doc_id int, page int, text string, y0 double, y1 double")
    got = {x.top: x.section for x in layout.heading_marks(items, FORM).collect()}
    assert got == {0.0: "identification", 10.0: "findings", 30.0: "thickness", 40.0: "findings"}
    assert SequenceMatcher(None, "2inspectionfinpings", "2inspectionfindings").ratio() >= 0.88


def test_spans_go_on_over_pages(spark):
    pages = one(spark, [(1, n, 100.0) for n in (1, 2, 3, 4)] + [(2, 1, 100.0)], "doc_id int, page int, height double")
    marks = one(spark, [(1, 1, 10.0, 15.0, "a"), (1, 1, 60.0, 65.0, "b"), (1, 3, 0.0, 5.0, "c"), (1, 4, 50.0, 55.0, "a")], "doc_id int, page int, top double, bottom double, section string")
    got = sorted((x.page, x.top, x.end, x.section) for x in layout.section_spans(pages, marks).collect() if x.doc_id == 1)
    assert got == [(1, 15.0, 60.0, "a"), (1, 65.0, 100.0, "b"), (2, 0.0, 100.0, "b"), (3, 5.0, 100.0, "c"), (4, 0.0, 50.0, "c"), (4, 55.0, 100.0, "a")]
    assert layout.section_spans(pages, marks).filter("doc_id = 2").count() == 0


PIECE = "doc_id string, page int, page_height double, text string, x0 double, y0 double, x1 double, y1 double, bold boolean"


def test_pieces_join_into_lines_by_their_own_height(spark):
    rows = [("A", 1, 100.0, "right", 60.0, 10.0, 90.0, 20.0, None), ("A", 1, 100.0, "left  one", 5.0, 12.0, 50.0, 22.0, True), ("A", 1, 100.0, "tall", 5.0, 20.0, 50.0, 60.0, None), ("A", 1, 100.0, " ", 5.0, 90.0, 50.0, 92.0, None)]
    got = [(x.line, x.x0, x.y1, x.height, round(x.y_frac, 3), x.bold) for x in library.page_lines(one(spark, rows, PIECE)).orderBy("y0").collect()]
    assert got == [("left one right", 5.0, 22.0, 10.0, 0.15, True), ("tall", 5.0, 60.0, 40.0, 0.4, None)]
    near = [("B", 1, 100.0, "a", 5.0, 0.0, 9.0, 10.0, None), ("B", 1, 100.0, "b", 15.0, 0.0, 19.0, 40.0, None)]
    assert [x.line for x in library.page_lines(one(spark, near, PIECE)).collect()] == ["a b"]


def test_a_small_library(spark):
    body, foot = "running text that is long enough to set the height", "small"
    rows, at = [], {}

    def put(doc, page, text, height=10.0, y=None, bold=None):
        at[doc, page] = at.get((doc, page), 15) + 20 if y is None else y
        rows.append((doc, page, 400.0, text, 10.0, float(at[doc, page]), 100.0, at[doc, page] + height, bold))

    for doc in ("D-1", "D-2", "D-3"):
        for page in (1, 2, 3):
            put(doc, page, f"Report {doc} page {page}", y=5)
            put(doc, page, body + f" {page}", y=60)
            put(doc, page, f"{page}. Scope of it", bold=page != 2)
            put(doc, page, "1. Scope ....... 4", bold=True)
            put(doc, page, body + " again")
            put(doc, page, "9", height=4.0)
            put(doc, page, foot, height=7.0)
            put(doc, page, str(page), height=7.0, y=390)
    put("D-4", 1, "1. Only a heading here", bold=True)
    lines = library.page_lines(one(spark, rows, PIECE))
    shaped = lines.withColumn("shape", library.own_shape(F.col("line"), F.col("doc_id")))
    assert {x.shape: x.n_docs for x in library.library_shapes(shaped, 4).collect()}["report\x01page"] == 3
    got = [(x.doc_id, x.section, x.heading, x.part_of, x.part, x.page_first, x.page_last, x.text) for x in library.build(lines, 4).orderBy("doc_id", "part_of", "place", "part").collect()]
    assert {x[0] for x in got} == {"D-1", "D-2", "D-3"}
    mine = [x[1:] for x in got if x[0] == "D-1"]
    notes = [x for x in mine if x[2] == "notes"]
    # the bare page number after the note is a mark that no line follows
    assert [(x[0], x[1], x[6]) for x in notes] == [("footnotes", f"Footnotes, page {n}", "9 small") for n in (1, 2, 3)]
    text = [x for x in mine if x[2] == "text"]
    assert [(x[0], x[1], x[4], x[5]) for x in text] == [("0", "", 1, 1), ("1", "Scope of it", 1, 3), ("3", "Scope of it", 3, 3)]
    assert text[1][6].split("\n") == ["1. Scope ....... 4", body + " again", body + " 2", "2. Scope of it", "1. Scope ....... 4", body + " again", body + " 3"]
    small = library.build(lines, 4, limit=120).filter("doc_id = 'D-1' and section = '1'").orderBy("part").collect()
    assert [x.part for x in small] == [0, 1, 2] and "\n".join(x.text for x in small) == text[1][6]
    assert small[0].title == body + " 1" and small[0].embedded.startswith(f"D-1 {body} 1. Scope of it\n")


def test_starts_of_chunks(spark):
    rows = one(spark, [([5, 5, 5],), ([20, 1, 1],), ([],), ([10],), ([4, 5, 1, 9],)], "s array<int>")
    got = [x[0] for x in rows.select(library.starts(F.col("s"), 10)).collect()]
    assert got == [[0, 1, 2], [0, 1], [0], [0], [0, 2, 3]]


def test_notes_and_flags_of_replies(spark):
    replies = one(spark, [(1, "is Oslo tested", True, ""), (2, "is it", False, "The note lacks Paris and 12 of 7"), (3, "q", True, "Nothing on Oslo"), (4, "q", True, ""), (5, "q", None, None)], "answer_id int, question string, answerable boolean, missing string")
    sentences = one(spark, [(1, 1, "Whatever P1 says of Bergen stays. Mr. Holm", ["P1"]), (2, 1, "Never looked at: Rome", ["P1"]), (4, 1, "word " * 151, ["P1"]), (4, 2, "P1 has 3,000", ["P9", "P1"])], "answer_id int, nth int, text string, sources array<string>")
    passages = one(spark, [(i, "P1", "Bergen has 3000 of 12") for i in (1, 2, 3, 4)], "answer_id int, label string, text string")
    found = checks.reply_grounding(replies, sentences, passages, F.array(F.lit("whatever")), retrieval.identifiers, retrieval.bare_id, "Cite passages")
    assert sorted(((x.answer_id, x.nth, x.problem) for x in found.collect()), key=str) == sorted(
        [(1, 1, "names: Mr"), (1, 1, "names: Holm"), (2, None, "note names: Paris"), (2, None, "note number: 7"), (2, None, "cannot answer, but gives sentences"), (3, None, "note names: Oslo"), (3, None, "gives no sentences"), (4, None, "too long"), (4, 2, "cites: P9")], key=str
    )


def test_plans_leave_no_part_undone(spark):
    steps = one(spark, [(1, 1, "inspect", "R-1"), (1, 2, "write", "x"), (1, 3, "write", "y"), (2, 1, "ask", "about tk-1 and TK-12"), (3, 1, "code", "T9"), (5, 1, "odd", None)], "plan_id int, nth int, kind string, arg string")
    kinds = one(spark, [("inspect", True, True, False, False, True), ("write", False, False, False, False, False), ("ask", True, False, False, True, False), ("code", True, False, True, False, False)], "kind string, needs_arg boolean, takes_doc boolean, takes_task boolean, no_documents boolean, regulated boolean")
    parts = one(spark, [(1, "inspect", "a"), (1, "write", "b"), (2, "ask", "c"), (3, "code", "d"), (3, "none", "e  f"), (4, "none", "g"), (5, "none", "h")], "plan_id int, kind string, text string")
    documents = one(spark, [("R-1", "TK-1")], "doc string, name string")
    requests = one(spark, [(1, "read tk-1"), (2, "Draft a note"), (3, "draft a NOTE"), (4, "draft a note"), (5, "draft a note")], "plan_id int, text string")
    plans = one(spark, [(1, "nothing"), (2, ""), (3, None), (4, "no tool"), (5, " "), (6, "")], "plan_id int, not_possible string")
    found = checks.plan_problems(steps, kinds, 15, parts, documents, requests, one(spark, [("T1",)], "task string"), plans, None, ["draft a note"])
    assert {(x.plan_id, x.problem) for x in found.collect()} == {
        (1, "repeated: write"), (1, "said to be impossible, but every part has a step"), (2, "ask asks about: TK-1"), (2, "needs a regulated step"), (3, "no such task: T9"), (3, "undone: e f"), (3, "needs a regulated step"),
        (5, "unknown kind: odd"), (5, "undone: h"), (5, "no steps, and no reason"), (6, "no steps, and no reason"), (6, "no parts"),
    }


def test_numbers_are_rounded_half_to_even_and_counted(spark):
    from proofline.operators import rules

    headers = one(spark, [("d", "0.250", "P-12")], "doc_id string, corrosion_rate_mm_yr string, report_no string")
    readings = one(spark, [("d", "CML-1", "N3", "10.00", "12.325", "12.335", "12.4"), ("d", "CML-2", None, None, "l2.3", "7", "5")], "doc_id string, cml_id string, location string, nominal_mm string, previous_mm string, current_mm string, min_required_mm string")
    findings = one(spark, [("d", "F-9", "Major", "here", "35 mm", None, "Cl. 6.2")], "doc_id string, finding_id string, severity string, location string, description string, recommendation string, ref_clause string")
    got = {x.form for x in rules.allowed_numbers(headers, readings, findings).collect()}
    # rounded half to even; margins 0.065 and 2; two readings, one finding, two triggers
    assert got == {"10.00", "10", "12.325", "12.32", "12.335", "12.34", "12.4", "12.40", "7", "7.00", "5", "5.00", "0.065", "0.06", "2", "2.00", "0.250", "0.25", "12", "1", "3", "9", "35", "6.2"}


def test_allowed_numbers_meet_in_one_shuffle_of_what_was_read(spark):
    from proofline.operators import rules

    headers = one(spark, [("d", "1.50"), (None, "n/a")], "doc_id string, corrosion_rate_mm_yr string")
    readings = one(spark, [("x", "C", "N", "1", "2", "3", "4"), (None, "C", "N", None, None, "8", "8")], "doc_id string, cml_id string, location string, nominal_mm string, previous_mm string, current_mm string, min_required_mm string")
    findings = one(spark, [], "doc_id string, finding_id string, severity string, location string, description string, recommendation string, ref_clause string")
    found = rules.allowed_numbers(headers, readings, findings)
    got = {(x.doc_id, x.form) for x in found.collect()}
    # counts go with headers alone; nothing is counted for a document without a name
    assert {f for d, f in got if d == "x"} == {"1", "1.00", "2", "2.00", "3", "3.00", "4", "4.00", "1"}
    assert {f for d, f in got if d == "d"} == {"1.50", "1.5", "0"} and {f for d, f in got if d is None} == {"n/a", "8", "8.00", "0", "0.00"}
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning(doc_id") == 2  # the second is the first, reused


def test_allowed_numbers_are_compiled_and_read_odd_prints(spark):
    from proofline.operators import rules

    headers = one(spark, [], "doc_id string, corrosion_rate_mm_yr string")
    readings = one(spark, [("d", None, None, " 100 ", "-0.50", "1.0000005", "0.3"), ("e", None, None, "7.", "1e3", "2", None)], "doc_id string, cml_id string, location string, nominal_mm string, previous_mm string, current_mm string, min_required_mm string")
    findings = one(spark, [], "doc_id string, finding_id string, severity string, location string, description string, recommendation string, ref_clause string")
    found = rules.allowed_numbers(headers, readings, findings)
    got = {(x.doc_id, x.form) for x in found.collect()}
    assert {f for d, f in got if d == "d"} == {"100", "100.00", "-0.50", "-0.5", "1.0000005", "1.00", "0.3", "0.30", "0.700001", "0.70"}
    assert {f for d, f in got if d == "e"} == {"2", "2.00"}
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()  # Spark doesn't compile those


def test_margins_of_readings_are_not_hidden_by_another_rule(spark):
    import ast
    import pathlib

    from proofline.operators import rules

    schema = "doc_id string, cml_id string, current_mm string, min_required_mm string"
    readings = one(spark, [("d", "C1", "7.25", "8"), ("d", "C2", "l.1", "2"), ("d", "C3", "3", None), (None, "C4", "9", "9.000")], schema)
    got = {(x.doc_id, x.cml_id, float(x.margin_mm)) for x in rules.margins(readings).collect()}
    assert got == {("d", "C1", -0.75), (None, "C4", 0.0)}
    # nothing in the package is defined twice in one module, where the second would take the first one's name
    for path in pathlib.Path(rules.__file__).parents[1].rglob("*.py"):
        names = [x.name for x in ast.parse(path.read_text()).body if isinstance(x, ast.FunctionDef | ast.ClassDef)]
        assert len(names) == len(set(names)), path


def test_a_review_asks_with_reasons_and_enters_every_field(spark):
    from proofline.operators import rules

    schema = "doc_id string, cml_id string, nominal_mm string, previous_mm string, current_mm string, min_required_mm string, review_status string, method string"
    readings = one(spark, [("d", "C1", "9.5", "1.10", "l.1", "2.0", "needs review", "ocr"), ("d", "C2", "9.5", "1.10", "1.20", "2.00", "accepted", "ocr"), ("d", "C3", "9.5", "1", "1.2", "2", "needs review", "ocr")], schema)
    findings = one(spark, [("d", "F1", "", "ocr"), ("d", "F2", "Minor", "ocr")], "doc_id string, finding_id string, severity string, method string")
    problems = one(spark, [("d", "C1.nominal_mm: crop is dark"), ("d", "F1: row: torn")], "doc_id string, text string")
    got = {x.field: (x.kind, x.read_as, x.decimals, x.options, x.why) for x in rules.review_items(readings, findings, problems).collect()}
    grades = ["Critical", "Major", "Minor", "Observation"]
    assert got == {"C1.nominal_mm": ("number", "9.5", 1, [], ["crop is dark"]), "C1.current_mm": ("number", None, 2, [], []), "C3.current_mm": ("number", "1.2", 2, [], []), "F1.severity": ("grade", None, None, grades, ["row: torn"])}
    entries = one(spark, [("d", "C1", "nominal_mm", " 9.4 "), ("d", "C1", "current_mm", "1.10"), ("d", "C3", "current_mm", None)], "doc_id string, cml_id string, field string, value string")
    done = {x.cml_id: x for x in rules.apply_review(readings, entries, "qa").collect()}
    assert (done["C1"].nominal_mm, done["C1"].current_mm, done["C1"].review_status) == ("9.4", "1.10", "entered by qa") and done["C3"].review_status == "needs review"
    assert done["C1"].method == "ocr; nominal_mm entered by qa from the original report; current_mm entered by qa from the original report"
    assert {(x.field, x.read_as) for x in rules.review_log(readings, entries, "qa").collect()} == {("C1.nominal_mm", "9.5"), ("C1.current_mm", "l.1")}
    graded = rules.apply_grades(findings, one(spark, [("d", "F1", "Major ")], "doc_id string, finding_id string, value string"), "qa")
    assert {(x.finding_id, x.severity, x.method) for x in graded.collect()} == {("F1", "Major", "ocr; severity entered by qa from the original report"), ("F2", "Minor", "ocr")}


def test_only_listed_columns_leave(spark):
    import pytest

    from proofline.operators import store

    readings = one(spark, [("d", "C1", "1.2", "2", "accepted", "secret")], "doc_id string, cml_id string, current_mm string, min_required_mm string, review_status string, note string")
    assert store.snapshot(readings, columns=("current_mm", "cml_id")).first().rows == '[{"current_mm":"1.2","cml_id":"C1"}]'
    for barred in (("note",), ("cml_id", "doc_id"), ()):
        with pytest.raises(ValueError):
            store.snapshot(readings, columns=barred)
