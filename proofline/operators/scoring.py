"""Scores: read values against the truth, retrieval, stops, verdicts and plans."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.functions.exact import HYPHENS, exact, tidy

# What a note states, what a template leaves behind, and what a scorer looks for in a printed number.
BANNER = "DRAFT FOR ENGINEERING REVIEW — NOT AN APPROVAL"
PLACEHOLDER = r"(?i)\[(list|insert|add|enter|todo)[^\]]*\]|\{\{|\}\}"
PRINTED = r"-?\d+(?:\.\d+)?"


def same(got: Column, want: Column) -> Column:
    """Equal as printed: numbers by value, text after tidying; null is matched only by null."""
    a, b = exact(got), exact(want)
    return F.when(want.isNull(), got.isNull()).when(b.isNotNull(), F.coalesce(a == b, F.lit(False))).otherwise(tidy(got) == tidy(want))


def field_score(got: DataFrame, want: DataFrame, key: list[str]) -> DataFrame:
    """key, field, verdict: right, caught (wrong, but the row is flagged), wrong, missing row or extra row.

    got: key, field, value, flagged; want: key, field, value. A missing row's fields are not scored.
    """
    a = got.select(*key, "field", F.col("value").alias("got"), "flagged", F.lit(True).alias("is_got"))
    b = want.select(*key, "field", F.col("value").alias("want"), F.lit(True).alias("is_want"))
    both = a.join(b, [*key, "field"], "full_outer")
    verdict = (
        F.when(F.col("is_got").isNull(), "missing")
        .when(F.col("is_want").isNull(), "extra")
        .when(same(F.col("got"), F.col("want")), "right")
        .when(F.coalesce("flagged", F.lit(False)), "caught")
        .otherwise("wrong")
    )
    return both.select(*key, "field", verdict.alias("verdict"))


def score_totals(verdicts: DataFrame, by: str) -> DataFrame:
    """Counts of each verdict, by group and (group null) in all."""
    n = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    return verdicts.rollup(by).agg(*map(n, ("right", "caught", "wrong", "missing", "extra")))


def stop_classes(flags: DataFrame) -> DataFrame:
    """doc_id, verdict, n_wrong: a stop is right if any flagged value is wrong, else a false alarm. flags: doc_id, got, want."""
    wrong = ~same(F.col("got"), F.col("want"))
    return flags.groupBy("doc_id").agg(F.when(F.bool_or(wrong), "right stop").otherwise("false alarm").alias("verdict"), F.count_if(wrong).alias("n_wrong"))


def retrieval_score(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """query_id, found_at, all_found: the first rank at which something expected is, and whether all is there."""
    both = expected.join(hits, ["query_id", "doc_id"], "left")
    return both.groupBy("query_id").agg(F.min("rank0").alias("found_at"), F.bool_and(F.col("rank0").isNotNull()).alias("all_found"))


def verdict_summary(rows: DataFrame, by: str, verdict: str, seconds: str) -> DataFrame:
    """Rows, correct ones, their share and the median of seconds, by group and (group null) in all."""
    good = F.count_if(F.col(verdict) == "correct")
    return rows.rollup(by).agg(F.count("*").alias("n"), good.alias("correct"), F.round(good / F.count("*"), 3).alias("rate"), F.median(seconds).alias("median_seconds"))


def multiset_difference(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """columns, extra, missing: how many more of each row a has than b, and the other way; equal counts are left out."""
    count = lambda df, name: df.groupBy(*columns).agg(F.count("*").alias(name))
    both = count(a, "na").join(count(b, "nb"), columns, "full_outer")
    diff = F.coalesce("na", F.lit(0).cast("long")) - F.coalesce("nb", F.lit(0).cast("long"))
    return both.select(*columns, F.greatest(diff, F.lit(0).cast("long")).alias("extra"), F.greatest(-diff, F.lit(0).cast("long")).alias("missing")).filter("extra <> missing")


def readback(note: DataFrame, truth: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """key, check, ok: rows of a rendered note against the evidence, a check for each column and for presence."""
    a = note.select(*key, *[F.col(c).alias(f"note_{c}") for c in columns], F.lit(True).alias("in_note"))
    both = truth.join(a, key, "full_outer").withColumn("present", F.col("in_note").isNotNull())
    tests = [F.struct(F.lit("present").alias("check"), F.col("present").alias("ok"))]
    tests += [F.struct(F.lit(c).alias("check"), (F.col("present") & F.col(c).eqNullSafe(F.col(f"note_{c}"))).alias("ok")) for c in columns]
    return both.select(*key, F.explode(F.array(*tests)).alias("t")).select(*key, "t.check", "t.ok")


def note_checks(notes: DataFrame, rows: DataFrame, readings: DataFrame, note_findings: DataFrame, findings: DataFrame) -> DataFrame:
    """doc_id, check, subject, ok: everything that is read back from a written note.

    notes: doc_id, header, body, cells, signoff (array of what stands beside the roles), outcome (as decided); rows: doc_id,
    cml_id, current, minimum, status (as printed); readings: doc_id, cml_id, evidence_id, current, minimum, breached;
    note_findings: doc_id, finding_id, severity; findings: the same and evidence_id. A reading without a row fails as such
    and has no further checks; the status is worked out anew from ``breached``. A note without a sign-off table fails.
    """
    kinds = {"notes": notes, "rows": rows, "readings": readings, "told": note_findings, "findings": findings}
    types = {k: df.drop("doc_id").schema.simpleString() for k, df in kinds.items()}
    part = lambda k, df: df.select("doc_id", *[(F.struct(*df.drop("doc_id").columns) if name == k else F.lit(None).cast(types[name])).alias(name) for name in kinds])
    # all that belongs to a document meets in one grouping, as rows, which take less than lists begun before the shuffle; the rest is expressions over its arrays
    both = functools.reduce(DataFrame.unionByName, [part(k, df) for k, df in kinds.items()]).repartition("doc_id").groupBy("doc_id").agg(*[F.collect_list(k).alias(k) for k in kinds])
    test = lambda name, subject, ok: F.struct(F.lit(name).alias("check"), subject.alias("subject"), ok.alias("ok"))
    of_row = lambda r: F.filter("rows", lambda x: x["cml_id"] == r["cml_id"])
    status = lambda r: F.when(F.coalesce(r["breached"], F.lit(False)), "BELOW MIN").otherwise("OK")
    values = lambda r, x: F.trim(x["current"]).eqNullSafe(r["current"]) & F.trim(x["minimum"]).eqNullSafe(r["minimum"])
    seen = lambda r, x: F.array(test("values", r["cml_id"], values(r, x)), test("status", r["cml_id"], F.trim(x["status"]).eqNullSafe(status(r))))
    gone = lambda r: F.array(test("row", r["cml_id"], F.lit(False)))
    of_rows = F.flatten(F.transform("readings", lambda r: F.when(F.size(of_row(r)) == 0, gone(r)).otherwise(F.flatten(F.transform(of_row(r), lambda x: seen(r, x))))))
    same = lambda a, b: (a["finding_id"] == b["finding_id"]) & a["severity"].eqNullSafe(b["severity"])
    lacks = lambda one, other: F.exists(one, lambda a: ~F.exists(other, lambda b: F.coalesce(a["finding_id"] == b["finding_id"], F.lit(False))))
    differs = F.exists("findings", lambda a: F.exists("told", lambda b: (a["finding_id"] == b["finding_id"]) & ~same(a, b)))
    wrong = lacks("findings", "told") | lacks("told", "findings") | differs
    none = F.lit(None).cast("string")

    def of_note(n: Column) -> Column:
        cells, everything = F.coalesce(n["cells"], F.lit("")), F.concat_ws("\n", n["header"], n["body"], n["cells"])
        listed = lambda x: F.contains(cells, x["evidence_id"])
        return F.array(
            test("banner", none, F.coalesce(F.contains(n["header"], F.lit(BANNER)), F.lit(False))),
            test("outcome", none, F.coalesce(F.contains(n["cells"], F.concat(F.lit("RULES OUTCOME: "), n["outcome"])), F.lit(False))),
            test("findings", none, ~F.coalesce(wrong, F.lit(False))),
            test("ids", none, F.coalesce(F.forall("readings", listed) & F.forall("findings", listed), F.lit(True))),
            test("placeholders", none, ~F.rlike(everything, F.lit(PLACEHOLDER))),
            test("sign-off", none, F.coalesce(F.forall(n["signoff"], lambda c: F.trim(c) == ""), F.lit(False))),
        )

    found = F.concat(of_rows, F.flatten(F.transform("notes", of_note)))
    return both.select("doc_id", F.inline(found)).select("doc_id", "check", "subject", "ok")


def number_as_printed(text: Column) -> Column:
    """The first number in a text without zeros at its end; a text without one is itself behind "?", null is empty."""
    found = F.regexp_extract(text, f"({PRINTED})", 1)
    digits = F.when(F.contains(found, F.lit(".")), F.regexp_replace(found, r"\.?0*$", "")).otherwise(found)
    return F.when(text.isNull(), "").when(found == "", F.concat(F.lit("?"), text)).otherwise(digits)


def text_as_printed(text: Column) -> Column:
    """Text as the whole-page scorer compares it: hyphens and spaces folded, degree signs spelt out, lower case, null as empty."""
    spaced = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), HYPHENS, "-"), r"(?U)\s+", " ")
    return F.lower(F.replace(F.trim(spaced), F.lit("°"), F.lit("deg")))


def page_score(got: DataFrame, truth: DataFrame) -> DataFrame:
    """doc_id, fields, errors, critical_fields, critical_errors of reports that were read whole.

    got: doc_id, part (header, finding or reading), row, field, value; truth: the same and number (whether the field is
    compared as a number). Critical are the grade of a finding, each reading's row, and its fields but the location. All
    fields of a missing finding are wrong; a missing reading is one error. Invented rows are one error in a report.
    """
    key = ["doc_id", "part", "row", "field"]
    a, b = got.select(*key, F.col("value").alias("got"), F.lit(True).alias("is_got")), truth.select(*key, "value", "number", F.lit(True).alias("is_truth"))
    same = F.when(F.col("number"), number_as_printed(F.col("got")) == number_as_printed(F.col("value"))).otherwise(text_as_printed(F.col("got")) == text_as_printed(F.col("value")))
    reading, known = F.col("part") == "reading", F.col("is_truth").isNotNull()
    grave = F.when(reading, F.col("field") != "location").otherwise((F.col("part") == "finding") & (F.col("field") == "severity"))
    count = lambda c: F.count_if(known & c)
    rows = a.join(b, key, "full_outer").groupBy("doc_id", "part", "row").agg(
        F.bool_or(known).alias("known"), F.bool_or(F.col("is_got").isNotNull()).alias("there"),
        count(F.lit(True)).alias("n"), count(~same).alias("bad"), count(grave).alias("n_grave"), count(grave & ~same).alias("bad_grave"),
    )
    # "number" may be null only where there is no truth; such rows are not counted.
    gone, row = reading & F.col("known") & ~F.col("there"), F.when(reading & F.col("known"), 1).otherwise(0)
    missed = (F.col("part") == "finding") & F.col("known") & ~F.col("there")
    errors = F.when(gone, 1).when(missed, F.col("n")).otherwise(F.col("bad"))
    graves = F.when(gone, 1).when(missed, F.col("n_grave")).otherwise(F.col("bad_grave"))
    invented = F.max(F.when(~F.col("known") & (F.col("part") != "header"), 1).otherwise(0))
    return rows.groupBy("doc_id").agg(
        F.sum("n").alias("fields"), (F.sum(errors) + invented).alias("errors"),
        F.sum(F.col("n_grave") + row).alias("critical_fields"), (F.sum(graves) + invented).alias("critical_errors"),
    )
