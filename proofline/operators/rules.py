"""Deterministic rules over evidence: triggers, outcomes, approvals, review and the formulas of inspection."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions.exact import DECIMAL, GRADES, NUMBER, NUMBERS, exact, exact_text, grade_rank, printed_decimals
from proofline.operators.store import held

# A reading's numbers, a header's numbers and texts, the grades that escalate.
VALUES = ("nominal_mm", "previous_mm", "current_mm", "min_required_mm")
HEADER_VALUES = ("corrosion_rate_mm_yr", "remaining_life_yr", "design_pressure_barg", "design_temp_c", "year_built")
HEADER_TEXTS = ("equipment_tag", "report_no", "unit", "plant", "equipment_name", "inspection_type", "service_fluid", "inspector_cert", "inspection_date", "next_due_date")
ESCALATING = ("Major", "Critical")

#: What a rule's row is: a trigger escalates, a review item asks a person.
TRIGGER, REVIEW = "trigger", "review"


def margins(readings: DataFrame) -> DataFrame:
    """doc_id, cml_id, margin_mm (current less minimum) of readings that have both."""
    margin = (exact(F.col("current_mm")) - exact(F.col("min_required_mm"))).cast("decimal(18,6)")
    return readings.select("doc_id", "cml_id", margin.alias("margin_mm")).filter("margin_mm is not null")


def triggers(readings: DataFrame, findings: DataFrame) -> DataFrame:
    """doc_id, subject, rule_id, kind, why: a row for each trigger and each review item.

    A value that is missing (the current one named first) asks for review and gives no margin; a
    value at its minimum is not below it; a grade that is none of the four asks for review.
    """
    current, least = exact(F.col("current_mm")), exact(F.col("min_required_mm"))
    why = F.when(current.isNull(), "current missing").when(least.isNull(), "minimum missing").when(current < least, "below minimum")
    a = readings.select("doc_id", F.col("cml_id").alias("subject"), why.alias("why")).filter("why is not null")
    a = a.withColumn("rule_id", F.when(F.col("why") == "below minimum", "THK-01").otherwise("EVD-01"))
    rank = grade_rank(F.col("severity"))
    why = F.when(rank.isNull(), "grade not read").when(rank >= 2, F.col("severity"))
    b = findings.select("doc_id", F.col("finding_id").alias("subject"), why.alias("why")).filter("why is not null")
    b = b.withColumn("rule_id", F.when(F.col("why") == "grade not read", "EVD-01").otherwise("SEV-01"))
    return a.unionByName(b).withColumn("kind", F.when(F.col("rule_id") == "EVD-01", REVIEW).otherwise(TRIGGER))


def outcomes(reports: DataFrame, fired: DataFrame) -> DataFrame:
    """doc_id, outcome, n_triggers, n_review of every report: ESCALATE over NEEDS REVIEW over NO TRIGGER."""
    n = fired.groupBy("doc_id").agg(F.count_if(F.col("kind") == TRIGGER).alias("t"), F.count_if(F.col("kind") == REVIEW).alias("v"))
    t, v = F.coalesce("t", F.lit(0).cast("long")), F.coalesce("v", F.lit(0).cast("long"))
    outcome = F.when(t > 0, "ESCALATE").when(v > 0, "NEEDS REVIEW").otherwise("NO TRIGGER")
    return reports.select("doc_id").join(n, "doc_id", "left").select("doc_id", outcome.alias("outcome"), t.alias("n_triggers"), v.alias("n_review"))


def worst_severity(findings: DataFrame) -> DataFrame:
    """doc_id, severity: the gravest grade; null if no grade could be read."""
    return findings.groupBy("doc_id").agg(F.max_by("severity", grade_rank(F.col("severity"))).alias("severity"))


def approval_reason(reports: DataFrame, fired: DataFrame) -> DataFrame:
    """doc_id, requires_approval, approval_reason."""
    n = fired.groupBy("doc_id").agg(F.bool_or(F.col("rule_id") == "SEV-01").alias("s"), F.bool_or(F.col("rule_id") == "THK-01").alias("t"))
    s, t = F.coalesce("s", F.lit(False)), F.coalesce("t", F.lit(False))
    reason = F.when(s & t, "severity_and_thickness").when(s, "severity").when(t, "thickness_only").otherwise("none")
    return reports.select("doc_id").join(n, "doc_id", "left").select("doc_id", (s | t).alias("requires_approval"), reason.alias("approval_reason"))


def loss(readings: DataFrame) -> DataFrame:
    """Adds loss_mm: previous less current, to two places; null if either is."""
    return readings.withColumn("loss_mm", (exact(F.col("previous_mm")) - exact(F.col("current_mm"))).cast("decimal(18,2)"))


def gate(reports: DataFrame, readings: DataFrame, findings: DataFrame) -> DataFrame:
    """doc_id, reason: the first of three reasons why evidence may not go on to the rules; null if it may."""
    r = readings.groupBy("doc_id").agg(F.count_if(held(F.col("review_status"))).alias("held"), F.count("*").alias("n_readings"))
    f = findings.groupBy("doc_id").agg(F.count_if(grade_rank(F.col("severity")).isNull()).alias("ungraded"), F.count("*").alias("n_findings"))
    reason = F.when(F.col("held") > 0, "values need a person").when(F.col("ungraded") > 0, "grade not read").when(F.col("n_readings").isNull() | F.col("n_findings").isNull(), "table not read")
    return reports.select("doc_id").join(r, "doc_id", "left").join(f, "doc_id", "left").select("doc_id", reason.alias("reason"))


def short_form(text: Column) -> Column:
    """A number as printed, without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def short_number(text: Column) -> Column:
    """``short_form`` of what ``exact_text`` gives, without an expression."""
    return F.when(F.contains(text, F.lit(".")), F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))).otherwise(text)


def two_places(number: Column) -> Column:
    """A decimal with two places, rounded half to even."""
    return F.bround(number, 2).cast("decimal(18,2)").cast("string")


def printed_forms(rows: DataFrame, names: tuple[str, ...], current: str, least: str, out: str) -> DataFrame:
    """Adds ``out``: every way to print the numbers of a row (as read, with two places, without trailing zeros) and the distance of two of them,
    with the places of the one that has more and with two; nulls where one is no number.

    Each step is a projection of its own, so that a number is read once; nothing of it is a lambda, which Spark would not compile.
    """
    text, number, places = {c: f"{out}_t_{c}" for c in names}, {c: f"{out}_n_{c}" for c in names}, [f"{out}_p_{c}" for c in (current, least)]
    rows = rows.withColumns({text[c]: exact_text(F.col(c)) for c in names})
    point = lambda c: F.instr(F.col(text[c]), ".")
    decimals = {p: F.when(point(c) > 0, F.length(F.col(text[c])) - point(c)).otherwise(0) for p, c in zip(places, (current, least), strict=True)}
    rows = rows.withColumns({number[c]: F.col(text[c]).try_cast(DECIMAL) for c in names} | decimals)
    far, most = f"{out}_far", f"{out}_most"
    rows = rows.withColumns({far: F.abs(F.col(number[current]) - F.col(number[least])), most: F.greatest(*places)})
    whole = f"{out}_whole"
    rows = rows.withColumn(whole, F.col(far).cast("string"))
    cut = F.when(F.col(most) == 0, F.substring_index(F.col(whole), ".", 1)).otherwise(F.substr(F.col(whole), F.lit(1), F.length(F.col(whole)) - 6 + F.col(most)))
    forms = [form for c in names for form in (F.col(text[c]), two_places(F.col(number[c])), short_number(F.col(text[c])))]
    return rows.withColumn(out, F.array(*forms, cut, two_places(F.col(far)))).drop(*text.values(), *number.values(), *places, far, most, whole)


def allowed_numbers(headers: DataFrame, readings: DataFrame, findings: DataFrame) -> DataFrame:
    """doc_id, form: every number that a summary of a document may hold.

    headers: doc_id and its fields as text; readings: doc_id, cml_id, location and the four values as printed; findings: doc_id, finding_id, severity, location,
    description, recommendation, ref_clause. Allowed are the values as printed, with two places and without trailing zeros; margins
    without their sign, also with two places; the header's values as printed and without trailing zeros, and the numbers in its texts and dates; the numbers in
    the words of findings and in readings' names and places; how many findings, readings and triggers there are.

    Rows meet by document as they are read, in one shuffle; their numbers are made after it.
    """
    have = lambda names: [c for c in names if c in headers.columns]
    none = F.array().cast("array<string>")
    listed = lambda columns: F.array(*map(F.col, columns)) if columns else none
    low = exact(F.col("current_mm")) < exact(F.col("min_required_mm"))
    part = lambda rows, kind, values, words, trigger: rows.select("doc_id", F.lit(kind).alias("kind"), listed(values).alias("values"), F.concat_ws(" ", *words).alias("words"), F.coalesce(trigger, F.lit(False)).alias("trigger"))
    rows = part(headers, "header", have(HEADER_VALUES), have(HEADER_TEXTS), F.lit(False))
    rows = rows.unionByName(part(readings, "reading", VALUES, ("cml_id", "location"), low))
    rows = rows.unionByName(part(findings, "finding", (), ("ref_clause", "finding_id", "location", "description", "recommendation"), F.col("severity").isin(*ESCALATING)))
    of_header = F.array(*[form for i in range(len(have(HEADER_VALUES))) for v in [F.get("values", F.lit(i))] for form in (v, F.when(exact_text(v).isNotNull(), short_form(v)))]).cast("array<string>")
    met = rows.repartition("doc_id")
    at = {f"v_{c}": F.when(F.col("kind") == "reading", F.get("values", F.lit(i))) for i, c in enumerate(VALUES)}
    printed = printed_forms(met.withColumns(at), tuple(at), "v_current_mm", "v_min_required_mm", "forms")
    own = F.when(F.col("kind") == "header", of_header).when(F.col("kind") == "reading", F.col("forms")).otherwise(none)
    forms = printed.select("doc_id", F.explode(F.array_distinct(F.concat(own, F.regexp_extract_all("words", F.lit(f"({NUMBERS})"), F.lit(1))))).alias("form")).filter("form is not null")
    number = lambda kind: F.count_if(F.col("kind") == kind)
    counts = met.groupBy("doc_id").agg(number("header").alias("h"), number("reading").alias("n"), number("finding").alias("m"), F.count_if("trigger").alias("t")).filter("h > 0")
    counted = counts.select("doc_id", F.explode(F.array(*[F.when(F.col("doc_id").isNotNull(), F.col(c)).otherwise(0).cast("string") for c in "nmt"])).alias("form"))
    return forms.unionByName(counted).distinct()


def doubts(problems: DataFrame) -> DataFrame:
    """doc_id, field, why: what is doubted about each value. problems: doc_id, text ("name.field: reason" or "name: reason")."""
    rows = problems.select("doc_id", F.substring_index("text", ": ", 1).alias("field"), F.regexp_extract("text", r"(?s)^.*?: (.*)$", 1).alias("reason"))
    return rows.groupBy("doc_id", "field").agg(F.array_sort(F.collect_list("reason")).alias("why"))


def review_items(readings: DataFrame, findings: DataFrame, problems: DataFrame, columns: tuple[str, ...] = VALUES) -> DataFrame:
    """doc_id, field, kind, read_as, decimals, options, why: what a person is asked about a document.

    Of a held row each value that is no number or that a problem names, or else its current one; of a finding without a grade its severity, with the grades to choose from. decimals is
    the column's most printed number of places in rows that are not held; of equally many, the one seen first by the reading's name. readings: doc_id, cml_id, review_status and the columns.
    """
    why = doubts(problems)
    cell = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).alias("nth"), F.col(c).alias("read_as")) for i, c in enumerate(columns)])).alias("v")
    cells = readings.select("doc_id", "cml_id", held(F.col("review_status")).alias("held"), cell).select("doc_id", "cml_id", "held", "v.*", F.concat_ws(".", "cml_id", "v.column").alias("field"))
    places = cells.filter("not held").withColumn("decimals", printed_decimals(F.col("read_as"))).filter("decimals is not null")
    counted = places.groupBy("doc_id", "column", "decimals").agg(F.count("*").alias("n"), F.min("cml_id").alias("first"))
    usual = counted.groupBy("doc_id", "column").agg(F.min(F.struct(-F.col("n"), "first", "decimals"))["decimals"].alias("decimals"))
    asked = cells.filter("held").join(why, ["doc_id", "field"], "left").withColumn("bad", exact_text(F.col("read_as")).isNull() | F.col("why").isNotNull())
    any_bad = F.bool_or("bad").over(Window.partitionBy("doc_id", "cml_id"))
    asked = asked.withColumn("any", any_bad).filter(F.col("bad") | (~F.col("any") & (F.col("column") == "current_mm"))).join(usual, ["doc_id", "column"], "left")
    empty = F.array().cast("array<string>")
    number = asked.select("doc_id", "field", F.lit("number").alias("kind"), exact_text(F.col("read_as")).alias("read_as"), "decimals", empty.alias("options"), F.coalesce("why", empty).alias("why"))
    ungraded = findings.filter(grade_rank(F.col("severity")).isNull()).select("doc_id", "finding_id", F.nullif(F.col("severity"), F.lit("")).alias("read_as"))
    both = why.withColumn("finding_id", F.regexp_replace("field", r"\.severity$", "")).groupBy("doc_id", "finding_id").agg(F.array_sort(F.flatten(F.collect_list("why"))).alias("why"))
    grade = ungraded.join(both, ["doc_id", "finding_id"], "left").select(
        "doc_id", F.concat("finding_id", F.lit(".severity")).alias("field"), F.lit("grade").alias("kind"), "read_as", F.lit(None).cast("int").alias("decimals"), F.array(*map(F.lit, sorted(GRADES))).alias("options"), F.coalesce("why", empty).alias("why")
    )
    return number.unionByName(grade)


def review_problems(items: DataFrame, entries: DataFrame) -> DataFrame:
    """key, field, problem: what is wrong with a person's entries. items: key, field, kind, decimals; entries: key, field, value.

    Entries for what is not under review, empty ones, grades that are none, numbers not as printed
    and numbers with other decimals than their column are problems; nothing is rounded or repaired.
    """
    value = F.trim(F.coalesce("value", F.lit("")))
    both = items.withColumn("asked", F.lit(True)).join(entries, ["key", "field"], "full_outer")
    problem = (
        F.when(F.col("asked").isNull(), "not under review")
        .when(value == "", "enter the value")
        .when((F.col("kind") == "grade") & ~value.isin(*GRADES), "not a grade")
        .when((F.col("kind") == "number") & ~value.rlike(NUMBER), "not a number as printed")
        .when((F.col("kind") == "number") & F.col("decimals").isNotNull() & (F.length(F.regexp_extract(value, r"\.(\d+)$", 1)) != F.col("decimals")), "other decimals")
    )
    return both.select("key", "field", problem.alias("problem")).filter("problem is not null")


def decision_problems(decisions: DataFrame) -> DataFrame:
    """key, problem: decisions (key, reviewer, action) without a name, or that neither confirm nor ask for a new measurement.

    One that asks for a new measurement needs no values: only those of ``confirmed`` decisions go to ``review_problems``.
    """
    named = F.when(F.trim(F.coalesce("reviewer", F.lit(""))) == "", "enter your name")
    action = F.when(~F.coalesce(F.col("action").isin("confirm", "remeasure"), F.lit(False)), "action must be confirm or remeasure")
    return decisions.select("key", F.explode(F.array_compact(F.array(named, action))).alias("problem"))


def confirmed(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows (key, ...) of decisions that confirm values; a new measurement, or no decision, leaves its values alone."""
    return rows.join(decisions.filter("action = 'confirm'").select("key").distinct(), "key", "left_semi")


def apply_review(readings: DataFrame, entries: DataFrame, reviewer: str, columns: tuple[str, ...] = VALUES) -> DataFrame:
    """Readings with entered values in place; their rows are no longer held and say who entered them.

    entries: doc_id, cml_id, value and field, the column that the value is of (without it, current_mm). Where readings have a ``method``, it says
    which values were entered, and by whom, in the order of the columns. Values of columns that readings lack are left out. ``review_log`` gives the audit rows.
    """
    columns = tuple(c for c in columns if c in readings.columns)
    field = F.col("field") if "field" in entries.columns else F.lit("current_mm")
    given = entries.filter("value is not null").withColumn("field", field).groupBy("doc_id", "cml_id").agg(*[F.max(F.when(F.col("field") == c, F.trim("value"))).alias(f"entered_{c}") for c in columns])
    both = readings.join(given, ["doc_id", "cml_id"], "left")
    entered = functools.reduce(lambda a, b: a | b, [F.col(f"entered_{c}").isNotNull() for c in columns])
    status = F.when(entered & held(F.col("review_status")), F.lit(f"entered by {reviewer}")).otherwise(F.col("review_status"))
    new = {c: F.coalesce(f"entered_{c}", c) for c in columns} | {"review_status": status}
    if "method" in readings.columns:
        notes = [F.when(F.col(f"entered_{c}").isNotNull(), f"; {c} entered by {reviewer} from the original report").otherwise("") for c in columns]
        new["method"] = F.concat("method", *notes)
    return both.withColumns(new).select(*readings.columns)


def apply_grades(findings: DataFrame, entries: DataFrame, reviewer: str) -> DataFrame:
    """Findings with entered grades in place (entries: doc_id, finding_id, value); where they have a ``method``, it says so."""
    given = entries.filter("value is not null").groupBy("doc_id", "finding_id").agg(F.max(F.trim("value")).alias("entered_"))
    new = {"severity": F.coalesce("entered_", "severity")}
    if "method" in findings.columns:
        new["method"] = F.concat("method", F.when(F.col("entered_").isNotNull(), f"; severity entered by {reviewer} from the original report").otherwise(""))
    return findings.join(given, ["doc_id", "finding_id"], "left").withColumns(new).select(*findings.columns)


def review_log(readings: DataFrame, entries: DataFrame, reviewer: str) -> DataFrame:
    """doc_id, field, entered, read_as, reviewer: a row for each value that a person entered (as in ``apply_review``), with what had been read."""
    field = F.col("field") if "field" in entries.columns else F.lit("current_mm")
    columns = [c for c in VALUES if c in readings.columns]
    read = F.coalesce(*[F.when(F.col("field") == c, F.col(c)) for c in columns])
    rows = entries.filter("value is not null").withColumn("field", field).join(readings.select("doc_id", "cml_id", *columns).distinct(), ["doc_id", "cml_id"])
    return rows.select("doc_id", F.concat_ws(".", "cml_id", "field").alias("field"), F.trim("value").alias("entered"), read.alias("read_as"), F.lit(reviewer).alias("reviewer"))


def shortfalls_rounded(readings: DataFrame) -> DataFrame:
    """Shortfalls to two places of readings strictly below their minimum; order: largest first, then cml_id."""
    short = (exact(F.col("min_required_mm")) - exact(F.col("current_mm"))).cast("decimal(18,6)")
    return readings.withColumn("exact_short", short).filter("exact_short > 0").withColumn("shortfall_mm", F.round("exact_short", 2).cast("decimal(18,2)")).drop("exact_short")


def remaining_life(rows: DataFrame) -> DataFrame:
    """Adds corrosion_rate_mm_yr (three places) and remaining_life_yr (one place, from the rounded rate).

    At or below the minimum the life is 0, even without loss; without loss it is null; an interval
    of years that is not positive fails.
    """
    d = lambda c: F.col(c).cast("decimal(18,6)")
    years = F.when(d("years") > 0, d("years")).otherwise(F.raise_error(F.lit("years must be positive")).cast("decimal(18,6)"))
    rate = F.round(((d("previous_mm") - d("current_mm")) / years).cast("decimal(28,10)"), 3).cast("decimal(18,3)")
    life = F.round(((d("current_mm") - d("min_required_mm")) / F.nullif(F.col("corrosion_rate_mm_yr"), F.lit(0))).cast("decimal(28,10)"), 1).cast("decimal(18,1)")
    with_rate = rows.withColumn("corrosion_rate_mm_yr", rate)
    zero = F.lit(0).cast("decimal(18,1)")
    return with_rate.withColumn("remaining_life_yr", F.when(d("current_mm") <= d("min_required_mm"), zero).when(F.col("corrosion_rate_mm_yr") > 0, life))


def next_due(rows: DataFrame) -> DataFrame:
    """Adds next_due: half of remaining_life_yr or max_interval_yr, whichever is less, down to whole years, but one at least.

    No life left gives the last inspection itself; 29 February moves to the 28th where there is none.
    """
    years = F.greatest(F.floor(F.least(F.col("remaining_life_yr") / 2, F.col("max_interval_yr"))), F.lit(1)).cast("int")
    return rows.withColumn("next_due", F.when(F.col("remaining_life_yr") <= 0, F.col("last_inspection")).otherwise(F.add_months("last_inspection", 12 * years)))
