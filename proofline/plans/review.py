"""Queries of the review round: numbers that a summary may hold, what a person is asked, what is entered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.operators import rules
from proofline.plans.evidence import doubtful
from proofline.plans.registry import query
from proofline.sources import tables as T
from proofline.sources.tables import READINGS, REPORT_FINDINGS, money, table

Spark = SparkSession

# Readings with four values (one of them printed with three places) and a place; findings with words that hold numbers.
FULL = f"""{READINGS}, {REPORT_FINDINGS}, fr AS (SELECT doc_id, cml_id, item, 'N' || (item % 30) || ' at ' || (item % 7) || '.5 m' AS location, (item % 40) || '.50' AS nominal, cur || '5' AS previous, cur::VARCHAR AS current, least::VARCHAR AS least, cur, least AS lim FROM readings),
    ff AS (SELECT doc_id, finding_id, severity, 'W-' || (doc_id % 13) AS location, 'wall of ' || (doc_id % 90) || ' mm' AS description, 'repair ' || (doc_id % 5) || '.25 m' AS recommendation, 'STD-' || (doc_id % 120) || ' Cl. ' || (doc_id % 9) || '.2' AS ref_clause FROM report_findings),
    hd AS (SELECT o_orderkey AS doc_id, o_orderstatus || '-' || (o_custkey % 900) AS equipment_tag, 'QA/INSP/' || (2000 + o_custkey % 25) || '/' || o_orderkey AS report_no, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || '0' AS corrosion_rate_mm_yr, CAST(1950 + o_custkey % 70 AS VARCHAR) AS year_built, '05-11-' || (2000 + o_custkey % 25) AS inspection_date FROM orders)"""


def full(spark: Spark, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Headers, readings and findings of every order."""
    item, n = F.col("item"), F.col("doc_id")
    readings = T.readings(spark, d).withColumns({"location": F.concat(F.lit("N"), item % 30, F.lit(" at "), item % 7, F.lit(".5 m")), "nominal_mm": F.concat(item % 40, F.lit(".50")), "previous_mm": F.concat("current_mm", F.lit("5"))})
    findings = T.report_findings(spark, d).select("doc_id", "finding_id", "severity", F.concat(F.lit("W-"), n % 13).alias("location"), F.concat(F.lit("wall of "), n % 90, F.lit(" mm")).alias("description"), F.concat(F.lit("repair "), n % 5, F.lit(".25 m")).alias("recommendation"), F.concat(F.lit("STD-"), n % 120, F.lit(" Cl. "), n % 9, F.lit(".2")).alias("ref_clause"))
    c = F.col("o_custkey")
    headers = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("doc_id"),
        F.concat("o_orderstatus", F.lit("-"), c % 900).alias("equipment_tag"),
        F.concat(F.lit("QA/INSP/"), 2000 + c % 25, F.lit("/"), "o_orderkey").alias("report_no"),
        F.concat(money("o_totalprice"), F.lit("0")).alias("corrosion_rate_mm_yr"),
        (1950 + c % 70).cast("string").alias("year_built"),
        F.concat(F.lit("05-11-"), 2000 + c % 25).alias("inspection_date"),
    )
    return headers, readings, findings


@query(f"""WITH {FULL}, half AS (SELECT *, CAST(cur * 100 AS BIGINT) AS q, CAST(abs(cur - lim) AS VARCHAR) AS margin FROM fr),
    v AS (SELECT doc_id, unnest([nominal, previous, current, least]) AS s FROM fr),
    w AS (SELECT doc_id, unnest(list_concat(regexp_extract_all(location, '[0-9]+(?:\\.[0-9]+)?'), regexp_extract_all(cml_id, '[0-9]+(?:\\.[0-9]+)?'))) AS form FROM fr
        UNION ALL SELECT doc_id, unnest(regexp_extract_all(concat_ws(' ', ref_clause, finding_id, location, description, recommendation), '[0-9]+(?:\\.[0-9]+)?')) FROM ff
        UNION ALL SELECT doc_id, unnest(regexp_extract_all(concat_ws(' ', equipment_tag, report_no, inspection_date), '[0-9]+(?:\\.[0-9]+)?')) FROM hd
        UNION ALL SELECT doc_id, s FROM v UNION ALL SELECT doc_id, rtrim(rtrim(s, '0'), '.') FROM v
        UNION ALL SELECT doc_id, CAST(CAST(q + q % 2 AS DECIMAL(18,0)) / 100 AS DECIMAL(18,2))::VARCHAR FROM half UNION ALL SELECT doc_id, margin FROM half
        UNION ALL SELECT doc_id, corrosion_rate_mm_yr FROM hd UNION ALL SELECT doc_id, rtrim(rtrim(corrosion_rate_mm_yr, '0'), '.') FROM hd UNION ALL SELECT doc_id, year_built FROM hd
        UNION ALL SELECT hd.doc_id, unnest([coalesce(a.n, 0), coalesce(b.n, 0), coalesce(a.t, 0) + coalesce(b.t, 0)])::VARCHAR FROM hd LEFT JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (cur < lim) AS t FROM fr GROUP BY 1) a ON a.doc_id = hd.doc_id
            LEFT JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (severity IN ('Major', 'Critical')) AS t FROM ff GROUP BY 1) b ON b.doc_id = hd.doc_id),
    u AS (SELECT DISTINCT doc_id, form FROM w) SELECT doc_id, count(*) AS n_forms, sha256(string_agg(form, ',' ORDER BY form)) AS forms FROM u GROUP BY doc_id""")
def allowed_numbers(spark: Spark, d: str) -> DataFrame:
    """Every number that a summary of an order may hold: values, margins, header, words, counts."""
    forms = rules.allowed_numbers(*full(spark, d))
    return forms.groupBy("doc_id").agg(F.count("*").alias("n_forms"), F.sha2(F.array_join(F.array_sort(F.collect_list("form")), ","), 256).alias("forms"))


# What is doubted about held rows and findings, as the reader notes it.
ASKED = f"""{READINGS}, {REPORT_FINDINGS}, b AS (SELECT doc_id, cml_id, review_status = 'needs review' AS held, item, unnest(['current_mm', 'min_required_mm']) AS col, unnest([CASE WHEN item % 5 = 0 THEN 'l' ELSE '' END || cur, least::VARCHAR]) AS read_as FROM readings),
    pr AS (SELECT DISTINCT doc_id, cml_id || '.min_required_mm' AS field, unnest(CASE WHEN item % 6 = 0 THEN ['crop is dark: 3', 'less than sure'] ELSE ['less than sure'] END) AS reason FROM readings WHERE item % 3 = 0
        UNION ALL SELECT doc_id, unnest([finding_id, finding_id || '.severity']), unnest(['row is torn', 'blurred']) FROM report_findings WHERE doc_id % 4 = 0),
    why AS (SELECT doc_id, field, list_sort(list(reason)) AS why FROM pr GROUP BY ALL),
    bad AS (SELECT b.*, b.cml_id || '.' || col AS field, coalesce(why, []) AS why, read_as LIKE 'l%' OR why IS NOT NULL AS bad FROM b LEFT JOIN why ON why.doc_id = b.doc_id AND why.field = b.cml_id || '.' || col WHERE held),
    an AS (SELECT *, bool_or(bad) OVER (PARTITION BY doc_id, cml_id) AS any_bad FROM bad), us AS (SELECT DISTINCT doc_id, col, 2 AS decimals FROM b WHERE NOT held AND read_as NOT LIKE 'l%'),
    it AS (SELECT an.doc_id, field, 'number' AS kind, CASE WHEN read_as NOT LIKE 'l%' THEN read_as END AS read_as, decimals, '' AS options, why FROM an LEFT JOIN us ON us.doc_id = an.doc_id AND us.col = an.col WHERE bad OR (NOT any_bad AND an.col = 'current_mm')
        UNION ALL SELECT r.doc_id, finding_id || '.severity', 'grade', severity, NULL, 'Critical,Major,Minor,Observation', CASE WHEN r.doc_id % 4 = 0 THEN ['blurred', 'row is torn'] ELSE [] END FROM report_findings r WHERE severity NOT IN ('Critical', 'Major', 'Minor', 'Observation'))"""


def noted(spark: Spark, d: str) -> DataFrame:
    """doc_id, text of what the reader doubts."""
    r, f = T.readings(spark, d), T.report_findings(spark, d)
    item = F.col("item")
    reasons = F.when(item % 6 == 0, F.array(F.lit("crop is dark: 3"), F.lit("less than sure"))).otherwise(F.array(F.lit("less than sure")))
    a = r.filter(item % 3 == 0).select("doc_id", "cml_id", F.explode(reasons).alias("why")).distinct().select("doc_id", F.concat("cml_id", F.lit(".min_required_mm: "), "why").alias("text"))
    b = f.filter("doc_id % 4 = 0").select("doc_id", F.explode(F.array(F.concat("finding_id", F.lit(": row is torn")), F.concat("finding_id", F.lit(".severity: blurred")))).alias("text"))
    return a.unionByName(b)


def asked(spark: Spark, d: str) -> DataFrame:
    return rules.review_items(doubtful(spark, d), T.report_findings(spark, d), noted(spark, d), ("current_mm", "min_required_mm"))


@query(f"WITH {ASKED} SELECT doc_id, field, kind, read_as, decimals, options, array_to_string(why, '; ') AS why FROM it")
def review_request(spark: Spark, d: str) -> DataFrame:
    """What a person is asked about held readings and findings without a grade, with what was read, the column's places, the grades to choose from and the reasons."""
    return asked(spark, d).select("doc_id", "field", "kind", "read_as", "decimals", F.array_join("options", ",").alias("options"), F.array_join("why", "; ").alias("why"))


# A person confirms some of the documents, asks for a new measurement of others, and says nothing of the rest.
ENTERED = f"""{ASKED}, e AS (SELECT DISTINCT doc_id, field, kind, CASE WHEN kind = 'grade' THEN CASE WHEN doc_id % 2 = 0 THEN 'Major' ELSE 'Minor' END ELSE doc_id % 90 || '.25' END AS value FROM it WHERE doc_id % 3 = 0)"""


def entries(spark: Spark, d: str) -> DataFrame:
    n = F.col("doc_id")
    value = F.when(F.col("kind") == "grade", F.when(n % 2 == 0, " Major ").otherwise("Minor")).otherwise(F.concat(n % 90, F.lit(".25")))
    decisions = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 3 == 0, "confirm").when(F.col("o_orderkey") % 3 == 1, "remeasure").alias("action"))
    rows = asked(spark, d).withColumn("key", n)
    return rules.confirmed(rows, decisions).select("doc_id", F.regexp_extract("field", r"^(.*)\.[^.]*$", 1).alias("cml_id"), F.regexp_extract("field", r"([^.]*)$", 1).alias("field"), "kind", value.alias("value")).distinct()


@query(f"""WITH {ENTERED}, r AS (SELECT r.doc_id, r.cml_id, item, review_status, CASE WHEN item % 5 = 0 THEN 'l' ELSE '' END || cur AS cur, least::VARCHAR AS least, a.value AS a, z.value AS z FROM readings r
        LEFT JOIN e a ON a.doc_id = r.doc_id AND a.field = r.cml_id || '.current_mm' LEFT JOIN e z ON z.doc_id = r.doc_id AND z.field = r.cml_id || '.min_required_mm')
    SELECT doc_id, cml_id AS name, coalesce(a, cur) AS current_mm, coalesce(z, least) AS min_required_mm, CASE WHEN review_status = 'needs review' AND (a IS NOT NULL OR z IS NOT NULL) THEN 'entered by qa' ELSE review_status END AS review_status,
        'ocr' || CASE WHEN a IS NOT NULL THEN '; current_mm entered by qa from the original report' ELSE '' END || CASE WHEN z IS NOT NULL THEN '; min_required_mm entered by qa from the original report' ELSE '' END AS method FROM r
    UNION ALL SELECT f.doc_id, finding_id, NULL, NULL, coalesce(value, severity), 'ocr' || CASE WHEN value IS NOT NULL THEN '; severity entered by qa from the original report' ELSE '' END FROM report_findings f LEFT JOIN e ON e.doc_id = f.doc_id AND e.field = finding_id || '.severity'""")
def review_entered(spark: Spark, d: str) -> DataFrame:
    """Values of both columns and grades, as entered where a person confirmed, in the evidence; rows say who entered what."""
    given, ocr = entries(spark, d), F.lit("ocr").alias("method")
    readings = rules.apply_review(doubtful(spark, d).withColumn("method", ocr), given.filter("kind = 'number'"), "qa")
    grades = given.filter("kind = 'grade'").select("doc_id", F.col("cml_id").alias("finding_id"), "value")
    findings = rules.apply_grades(T.report_findings(spark, d).withColumn("method", ocr), grades, "qa")
    none = F.lit(None).cast("string")
    a = readings.select("doc_id", F.col("cml_id").alias("name"), "current_mm", "min_required_mm", "review_status", "method")
    return a.unionByName(findings.select("doc_id", F.col("finding_id").alias("name"), none.alias("current_mm"), none.alias("min_required_mm"), F.col("severity").alias("review_status"), "method"))
