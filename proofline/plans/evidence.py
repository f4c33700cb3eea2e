"""Queries over evidence: store, rules, formulas, selection and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.functions import exact as X
from proofline.operators import quality, rules, selection, store
from proofline.plans.registry import query
from proofline.sources import tables as T
from proofline.sources.tables import FINDINGS, READINGS, REPORT_FINDINGS, table

Spark = SparkSession
GRADES = "('Observation', 'Minor', 'Major', 'Critical')"


@query(f"""WITH {READINGS} SELECT doc_id, cml_id, equipment_tag, CAST(CAST(least - cur AS DECIMAL(18,2)) AS VARCHAR) AS shortfall
    FROM readings WHERE review_status <> 'needs review' AND cur < least ORDER BY least - cur DESC, equipment_tag, doc_id, cml_id""")
def threshold_breach(spark: Spark, d: str) -> DataFrame:
    rows = store.in_order(store.below_minimum(T.readings(spark, d)), "shortfall_mm")
    return rows.select("doc_id", "cml_id", "equipment_tag", F.col("shortfall_mm").cast("decimal(18,2)").cast("string").alias("shortfall"))


PREVIOUS = "lag(cur) OVER (PARTITION BY item ORDER BY moment, doc_id, cml_id, cur)"


def with_previous(spark: Spark, d: str) -> DataFrame:
    return store.with_previous(T.readings(spark, d), "item", "moment", "doc_id", "cml_id", F.col("current_mm").cast("decimal(18,2)"))


@query(f"""WITH {READINGS}, p AS (SELECT *, {PREVIOUS} AS prev FROM readings)
    SELECT doc_id, cml_id, CAST(CAST(cur - prev AS DECIMAL(18,2)) AS VARCHAR) AS grew FROM p WHERE review_status <> 'needs review' AND cur > prev""")
def value_grew(spark: Spark, d: str) -> DataFrame:
    return store.thickness_grew(with_previous(spark, d)).select("doc_id", "cml_id", F.col("grew_by").cast("decimal(18,2)").cast("string").alias("grew"))


@query(f"""WITH {READINGS} SELECT count(*) FILTER (review_status = 'needs review') AS held, 0::BIGINT AS held_if_included FROM readings""")
def held_counts(spark: Spark, d: str) -> DataFrame:
    rows = T.readings(spark, d)
    return store.held_count(rows).crossJoin(store.held_count(rows, include_unreviewed=True).withColumnRenamed("held", "held_if_included"))


@query(f"""WITH {FINDINGS} SELECT doc_id, finding_id, ref_clause FROM findings WHERE lower(severity) = 'major' AND lower(equipment_tag) = 'tag-3'
    AND contains(regexp_replace(lower(ref_clause), '[^a-z0-9]', '', 'g'), 'cl52')""")
def findings_filter(spark: Spark, d: str) -> DataFrame:
    return store.find_findings(T.findings(spark, d), "MAJOR", "TAG-3", "Cl. 5.2").select("doc_id", "finding_id", "ref_clause")


@query(f"""WITH {READINGS}, {REPORT_FINDINGS},
    r AS (SELECT doc_id, count(*) AS n, min(cml_id) AS first FROM readings GROUP BY 1), f AS (SELECT doc_id, count(*) AS n FROM report_findings GROUP BY 1)
    SELECT o_orderkey AS doc_id, CAST(coalesce(r.n, 0) AS INTEGER) AS n_readings, CAST(coalesce(f.n, 0) AS INTEGER) AS n_findings, r.first AS first_reading
    FROM orders LEFT JOIN r ON r.doc_id = o_orderkey LEFT JOIN f ON f.doc_id = o_orderkey""")
def equipment_history(spark: Spark, d: str) -> DataFrame:
    reports = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"))
    rows = store.history(reports, T.readings(spark, d), T.report_findings(spark, d))
    return rows.select("doc_id", F.size("readings").alias("n_readings"), F.size("findings").alias("n_findings"), F.get("readings", F.lit(0))["cml_id"].alias("first_reading"))


@query(f"WITH {FINDINGS} SELECT DISTINCT ref_clause, regexp_replace(lower(ref_clause), '[^a-z0-9]', '', 'g') AS clause FROM findings")
def clause_normalise(spark: Spark, d: str) -> DataFrame:
    return T.findings(spark, d).select("ref_clause", X.bare(F.col("ref_clause")).alias("clause")).distinct()


TRIGGERS = f"""{READINGS}, {REPORT_FINDINGS}, fired AS (
    SELECT doc_id, cml_id AS subject, 'THK-01' AS rule_id, 'trigger' AS kind, 'below minimum' AS why FROM readings WHERE cur < least
    UNION ALL SELECT doc_id, finding_id, CASE WHEN severity IN {GRADES} THEN 'SEV-01' ELSE 'EVD-01' END, CASE WHEN severity IN {GRADES} THEN 'trigger' ELSE 'review' END,
        CASE WHEN severity IN {GRADES} THEN severity ELSE 'grade not read' END FROM report_findings WHERE severity NOT IN ('Observation', 'Minor'))"""


def fired(spark: Spark, d: str) -> DataFrame:
    return rules.triggers(T.readings(spark, d), T.report_findings(spark, d))


def reports(spark: Spark, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"))


@query(f"WITH {TRIGGERS} SELECT * FROM fired")
def rules_triggers(spark: Spark, d: str) -> DataFrame:
    return fired(spark, d)


@query(f"""WITH {TRIGGERS}, n AS (SELECT o_orderkey AS doc_id, count(*) FILTER (kind = 'trigger') AS n_triggers, count(*) FILTER (kind = 'review') AS n_review
    FROM orders LEFT JOIN fired ON fired.doc_id = o_orderkey GROUP BY 1)
    SELECT doc_id, CASE WHEN n_triggers > 0 THEN 'ESCALATE' WHEN n_review > 0 THEN 'NEEDS REVIEW' ELSE 'NO TRIGGER' END AS outcome, n_triggers, n_review FROM n""")
def rules_outcome(spark: Spark, d: str) -> DataFrame:
    return rules.outcomes(reports(spark, d), fired(spark, d))


@query(f"""WITH {FINDINGS} SELECT doc_id, list_extract(['Observation', 'Minor', 'Major', 'Critical'], max(list_position(['Observation', 'Minor', 'Major', 'Critical'], severity))) AS severity
    FROM findings GROUP BY doc_id""")
def worst_severity(spark: Spark, d: str) -> DataFrame:
    return rules.worst_severity(T.findings(spark, d))


@query(f"""WITH {TRIGGERS}, n AS (SELECT o_orderkey AS doc_id, coalesce(bool_or(rule_id = 'SEV-01'), false) AS s, coalesce(bool_or(rule_id = 'THK-01'), false) AS t
    FROM orders LEFT JOIN fired ON fired.doc_id = o_orderkey GROUP BY 1)
    SELECT doc_id, s OR t AS requires_approval, CASE WHEN s AND t THEN 'severity_and_thickness' WHEN s THEN 'severity' WHEN t THEN 'thickness_only' ELSE 'none' END AS approval_reason FROM n""")
def approval_reason(spark: Spark, d: str) -> DataFrame:
    return rules.approval_reason(reports(spark, d), fired(spark, d))


@query(f"WITH {READINGS}, p AS (SELECT *, {PREVIOUS} AS prev FROM readings) SELECT doc_id, cml_id, CAST(CAST(prev - cur AS DECIMAL(18,2)) AS VARCHAR) AS loss FROM p")
def loss(spark: Spark, d: str) -> DataFrame:
    return rules.loss(with_previous(spark, d)).select("doc_id", "cml_id", F.col("loss_mm").cast("string").alias("loss"))


@query(f"WITH {READINGS} SELECT doc_id, cml_id, CAST(cur - least AS DOUBLE) AS margin FROM readings")
def margins(spark: Spark, d: str) -> DataFrame:
    return rules.margins(T.readings(spark, d)).select("doc_id", "cml_id", F.col("margin_mm").cast("double").alias("margin"))


@query(f"""WITH {READINGS}, {REPORT_FINDINGS}, r AS (SELECT doc_id, count(*) FILTER (review_status = 'needs review') AS held FROM readings GROUP BY 1),
    f AS (SELECT doc_id, count(*) FILTER (severity NOT IN {GRADES}) AS bad FROM report_findings GROUP BY 1)
    SELECT o_orderkey AS doc_id, CASE WHEN held > 0 THEN 'values need a person' WHEN bad > 0 THEN 'grade not read' WHEN held IS NULL OR bad IS NULL THEN 'table not read' END AS reason
    FROM orders LEFT JOIN r ON r.doc_id = o_orderkey LEFT JOIN f ON f.doc_id = o_orderkey""")
def evidence_gate(spark: Spark, d: str) -> DataFrame:
    return rules.gate(reports(spark, d), T.readings(spark, d), T.report_findings(spark, d))


def doubtful(spark: Spark, d: str) -> DataFrame:
    """Readings of which some current values can't be read: every part key divisible by 5 has a letter for a digit."""
    bad = F.when(F.col("item") % 5 == 0, F.concat(F.lit("l"), "current_mm")).otherwise(F.col("current_mm"))
    return T.readings(spark, d).withColumn("current_mm", bad)


@query("""WITH i AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'grade' ELSE 'number' END AS kind FROM orders WHERE o_orderkey % 11 <> 0),
    e AS (SELECT o_orderkey AS k, CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'Major' WHEN 2 THEN '12.3' WHEN 3 THEN 'l2.30' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS v FROM orders WHERE o_orderkey % 13 <> 0),
    j AS (SELECT coalesce(i.k, e.k) AS k, i.kind, i.k IS NULL AS extra, coalesce(v, '') AS v FROM i FULL JOIN e ON i.k = e.k),
    p AS (SELECT k AS key, 'value' AS field, CASE WHEN extra THEN 'not under review' WHEN v = '' THEN 'enter the value' WHEN kind = 'grade' AND v NOT IN ('Observation', 'Minor', 'Major', 'Critical') THEN 'not a grade'
        WHEN kind = 'number' AND NOT regexp_full_match(v, '-?[0-9]+([.][0-9]+)?') THEN 'not a number as printed' WHEN kind = 'number' AND len(split_part(v, '.', 2)) <> 2 THEN 'other decimals' END AS problem FROM j)
    SELECT * FROM p WHERE problem IS NOT NULL""")
def review_problems(spark: Spark, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("key", F.col("o_orderkey")).withColumn("field", F.lit("value"))
    kind = F.when(F.col("key") % 3 == 0, "grade").otherwise("number")
    items = o.filter("key % 11 <> 0").select("key", "field", kind.alias("kind"), F.lit(2).alias("decimals"))
    m = F.col("key") % 7
    value = F.when(m == 0, "").when(m == 1, "Major").when(m == 2, "12.3").when(m == 3, "l2.30").otherwise(T.money("o_totalprice"))
    return rules.review_problems(items, o.filter("key % 13 <> 0").select("key", "field", value.alias("value")))


@query(f"""WITH {READINGS}, e AS (SELECT DISTINCT doc_id, cml_id, '9.99' AS v FROM readings WHERE item % 5 = 0)
    SELECT doc_id, cml_id, coalesce(v, CAST(cur AS VARCHAR)) AS current_mm, CASE WHEN v IS NOT NULL AND review_status = 'needs review' THEN 'entered by qa lead' ELSE review_status END AS review_status
    FROM readings LEFT JOIN e USING (doc_id, cml_id)""")
def review_applied(spark: Spark, d: str) -> DataFrame:
    entries = doubtful(spark, d).filter("item % 5 = 0").select("doc_id", "cml_id", F.lit("9.99").alias("value")).distinct()
    return rules.apply_review(doubtful(spark, d), entries, "qa lead").select("doc_id", "cml_id", "current_mm", "review_status")


@query(f"WITH {READINGS} SELECT doc_id, cml_id, CAST(least - cur AS DOUBLE) AS shortfall FROM readings WHERE cur < least")
def shortfall_rounded(spark: Spark, d: str) -> DataFrame:
    return rules.shortfalls_rounded(T.readings(spark, d)).select("doc_id", "cml_id", F.col("shortfall_mm").cast("double").alias("shortfall"))


@query("""WITH v AS (SELECT o_orderkey AS doc_id, CAST(o_totalprice / 10000 AS DECIMAL(18,2)) AS cur, CAST(o_totalprice / 10000 + (o_orderkey % 9 - 2) AS DECIMAL(18,2)) AS prev, CAST(o_orderkey % 6 + 1 AS INTEGER) AS years,
        CAST(o_custkey % 40 AS DECIMAL(18,2)) AS least FROM orders),
    i AS (SELECT doc_id, CAST(cur * 100 AS BIGINT) AS cur, CAST(prev * 100 AS BIGINT) AS prev, CAST(least * 100 AS BIGINT) AS least, years FROM v),
    r AS (SELECT *, sign(prev - cur) * ((2 * abs(prev - cur) * 10 + years) // (2 * years)) AS rate FROM i)
    SELECT doc_id, rate / 1000.0::DOUBLE AS rate, CASE WHEN cur <= least THEN 0.0::DOUBLE WHEN rate > 0 THEN ((2 * (cur - least) * 100 + rate) // (2 * rate)) / 10.0::DOUBLE END AS life FROM r""")
def remaining_life(spark: Spark, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    price = F.col("o_totalprice") / 10000
    rows = o.select(
        F.col("o_orderkey").alias("doc_id"),
        price.cast("decimal(18,2)").alias("current_mm"),
        (price + (F.col("o_orderkey") % 9 - 2)).cast("decimal(18,2)").alias("previous_mm"),
        (F.col("o_orderkey") % 6 + 1).alias("years"),
        (F.col("o_custkey") % 40).cast("decimal(18,2)").alias("min_required_mm"),
    )
    return rules.remaining_life(rows).select("doc_id", F.col("corrosion_rate_mm_yr").cast("double").alias("rate"), F.col("remaining_life_yr").cast("double").alias("life"))


@query("""SELECT o_orderkey AS doc_id, strftime(CASE WHEN o_orderkey % 23 = 0 THEN CAST(o_orderdate AS DATE)
    ELSE CAST(CAST(o_orderdate AS DATE) + to_years(CAST(greatest(floor(least((o_orderkey % 23) / 2.0, 1 + o_orderkey % 5)), 1) AS INTEGER)) AS DATE) END, '%Y-%m-%d') AS due FROM orders""")
def next_due_date(spark: Spark, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").cast("date").alias("last_inspection"), (F.col("o_orderkey") % 23).alias("remaining_life_yr"), (1 + F.col("o_orderkey") % 5).alias("max_interval_yr")
    )
    return rules.next_due(rows).select("doc_id", F.date_format("next_due", "yyyy-MM-dd").alias("due"))


RESULTS = """m AS (SELECT n_name AS task, s_name AS model, s_suppkey AS id, s_acctbal AS bal, count(*) AS n, avg(l_discount) AS disc
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL)"""


def measured(spark: Spark, d: str) -> DataFrame:
    """Suppliers as candidates for their nation's task, with measured results."""
    s = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    n = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return s.join(n, F.col("s_suppkey") == F.col("l_suppkey")).select(F.col("n_name").alias("task"), F.col("s_name").alias("model"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal"), "n")


def gate_of(spark: Spark, d: str) -> tuple[DataFrame, DataFrame]:
    have = lambda k, c: F.struct(F.lit(k).alias("key"), c.cast("double").alias("have"))
    each = F.array(have("balance", F.col("bal")), have("orders_max", F.col("n")), have("parity", F.col("id") % 2))
    results = measured(spark, d).select("task", "model", F.inline(each)).filter("not (key = 'parity' and model like '%7')")
    gates = spark.createDataFrame([("balance", 0, "float", 0.0), ("orders_max", 1, "int", 610.0), ("parity", 2, "int", 1.0)], "key string, ord int, kind string, want double")
    return results, table(spark, d, "nation").select(F.col("n_name").alias("task")).join(F.broadcast(gates))


GATE = f"""{RESULTS}, g AS (SELECT task, model, CASE WHEN NOT bal >= 0 THEN 'balance' WHEN n > 610 THEN 'orders_max' WHEN model LIKE '%7' OR id % 2 <> 1 THEN 'parity' END AS key,
    CASE WHEN NOT bal >= 0 OR n > 610 THEN 'fails' WHEN model LIKE '%7' THEN 'not measured' WHEN id % 2 <> 1 THEN 'fails' END AS why, bal, n FROM m)"""


@query(f"WITH {GATE} SELECT task, model, key, why FROM g WHERE key IS NOT NULL")
def gate_results(spark: Spark, d: str) -> DataFrame:
    return selection.gate_failures(*gate_of(spark, d))


@query(f"""WITH {GATE}, r AS (SELECT *, CASE WHEN key IS NULL THEN row_number() OVER (PARTITION BY task, key IS NULL ORDER BY bal DESC NULLS LAST, model) END AS nth FROM g)
    SELECT task, max(CASE WHEN nth = 1 THEN model END) AS chosen, max(CASE WHEN nth = 2 THEN model END) AS runner_up, count(*) FILTER (key IS NULL) AS n_eligible FROM r GROUP BY task""")
def gate_rank_choose(spark: Spark, d: str) -> DataFrame:
    _, gates = gate_of(spark, d)
    lists = gates.groupBy("task").agg(F.array_sort(F.collect_list(F.struct("ord", "key", "kind", "want"))).alias("gates"))
    parity = F.when(~F.col("model").like("%7"), (F.col("id") % 2).cast("double"))
    have = F.create_map(F.lit("balance"), F.col("bal").cast("double"), F.lit("orders_max"), F.col("n").cast("double"), F.lit("parity"), parity)
    rows = measured(spark, d).join(F.broadcast(lists), "task").withColumn("reason", selection.first_failure(F.col("gates"), have)["key"])
    return selection.choose(rows, "task", "model", [F.desc_nulls_last("bal"), F.col("model")])


LADDER = """c AS (SELECT n_name AS task, s_name AS model, s_suppkey AS id, s_acctbal AS bal FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    w AS (SELECT *, CASE WHEN id % 11 = 0 THEN 'cannot: lacks tools, vision' WHEN id % 7 = 0 THEN 'cannot: lacks vision' WHEN id % 5 = 0 THEN 'not qualified: never tested for this task' WHEN id % 13 = 0 THEN 'not qualified: a candidate, but no qualification test has been run'
        WHEN bal < 0 THEN 'failed the safety gate: balance fails' WHEN id % 9 > 6 THEN 'does not fit: needs ' || (id % 9) || ' GB, 6 GB available' WHEN id % 3 = 0 THEN 'qualified, but not available on this machine' END AS reason FROM c)"""


@query(f"WITH {LADDER} SELECT task, model, reason FROM w")
def candidate_reasons(spark: Spark, d: str) -> DataFrame:
    """Why each candidate is out, by the first rung of the ladder that it misses."""
    i = F.col("s_suppkey")
    rows = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    has = F.when(i % 11 == 0, F.array(F.lit("text"))).when(i % 7 == 0, F.array(F.lit("text"), F.lit("tools"))).otherwise(F.array(F.lit("text"), F.lit("tools"), F.lit("vision")))
    gates = F.array(F.struct(F.lit("balance").alias("key"), F.lit("float").alias("kind"), F.lit(0.0).alias("want")))
    first = selection.first_failure(gates, F.create_map(F.lit("balance"), F.col("s_acctbal").cast("double")))
    gate = F.concat_ws(" ", first["key"], first["why"])
    reason = selection.ladder(F.array(F.lit("tools"), F.lit("vision")), has, i % 5 != 0, i % 13 != 0, F.when(first.isNotNull(), gate), i % 9, F.lit(6), i % 3 != 0)
    return rows.select(F.col("n_name").alias("task"), F.col("s_name").alias("model"), reason.alias("reason"))


RULE_LIST = [(r"\b(the|of)\b.*\bcode\b|\bscript\b", "code"), (r"\bnote for\b|\bsummary\b", "write_summary"), (r"\bthe\b", "english"), (r"\b(der|die|und)\b", "german")]


# word ends as Java and Python see them: RE2's own know no letters beyond ASCII
NOT = r"[^\p{L}\p{N}_]"


def _word(some: str) -> str:
    return f"(?:^|{NOT})(?:{some})(?:$|{NOT})"


def _gap(most: int) -> str:
    """Up to ``most`` signs of one sentence that begin and end outside words."""
    edge = NOT.replace("_]", "_.?!]")
    return f"(?:{edge}|{edge}[^.?!]{{0,{most - 2}}}{edge})"


@query(f"""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i){_word("the|of")}.*{_word("code")}|{_word("the|of")}code(?:$|{NOT})|{_word("script")}') THEN 'code' WHEN regexp_matches(text, '(?i){_word("note for|summary")}') THEN 'write_summary'
    WHEN regexp_matches(text, '(?i){_word("the")}') THEN 'english' WHEN regexp_matches(text, '(?i){_word("der|die|und")}') THEN 'german' ELSE 'tool_agent' END AS task FROM documents""")
def classify_rules(spark: Spark, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", selection.first_rule(F.col("text"), RULE_LIST, "tool_agent").alias("task"))


@query(f"""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)(?:^|{NOT})(?:is|was){_gap(60)}the(?:$|{NOT})') THEN 0 WHEN regexp_matches(text, '(?i)(?:^|{NOT})the{_gap(20)}(?:of|to)(?:$|{NOT})') THEN 1 END AS pattern FROM conversations""")
def regulated_by(spark: Spark, d: str) -> DataFrame:
    patterns = [r"\b(is|was)\b[^.?!]{0,60}\bthe\b", r"\bthe\b[^.?!]{0,20}\b(of|to)\b"]
    return table(spark, d, "conversations").select("conv_id", "turn", selection.first_pattern(F.col("text"), patterns).alias("pattern"))


@query("""SELECT conv_id, turn, role, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS nth FROM conversations)
    WHERE nth <= 3 AND trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''""")
def last_n_turns(spark: Spark, d: str) -> DataFrame:
    return selection.last_turns(table(spark, d, "conversations"), 3)


@query("""SELECT doc_id, name FROM documents, (VALUES ('license'), ('and'), ('the')) n(name) WHERE regexp_matches(text, '(?i)(^|[^\\w-])' || name || '($|[^\\w-])')""")
def named_documents(spark: Spark, d: str) -> DataFrame:
    names = spark.createDataFrame([("license",), ("and",), ("the",)], "name string")
    return selection.named(table(spark, d, "documents").select("doc_id", "text"), names).select("doc_id", "name")


@query("""WITH c AS (SELECT l_suppkey AS supp, l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 17 = 0 THEN CAST(CAST(l_extendedprice AS DECIMAL(18,1)) AS VARCHAR) WHEN l_partkey % 19 = 0 THEN 'l' || CAST(l_quantity AS INTEGER) ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END AS v FROM lineitem),
    n AS (SELECT *, len(split_part(v, '.', 2)) AS dec FROM c WHERE regexp_full_match(v, '-?[0-9]+([.][0-9]+)?')), s AS (SELECT supp, dec, count(*) AS k, min((l_orderkey, l_linenumber, l_partkey)) AS first FROM n GROUP BY 1, 2),
    u AS (SELECT *, sum(k) OVER (PARTITION BY supp) AS total, row_number() OVER (PARTITION BY supp ORDER BY k DESC, first) AS nth FROM s)
    SELECT n.supp, l_orderkey, v AS value, CAST(n.dec AS INTEGER) AS decimals, CAST(u.dec AS INTEGER) AS usual FROM n JOIN u ON u.supp = n.supp AND nth = 1 AND total > 3 AND k >= 3 WHERE n.dec <> u.dec""")
def precision_outliers(spark: Spark, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    price = lambda n: F.col("l_extendedprice").cast(f"decimal(18,{n})").cast("string")
    value = F.when(F.col("l_partkey") % 17 == 0, price(1)).when(F.col("l_partkey") % 19 == 0, F.concat(F.lit("l"), F.col("l_quantity").cast("int"))).otherwise(price(2))
    cells = li.select(F.col("l_suppkey").alias("supp"), "l_orderkey", "l_linenumber", "l_partkey", value.alias("value"))
    found = quality.precision_outliers(cells, ["supp"], "value", ["l_orderkey", "l_linenumber", "l_partkey"])
    return found.select("supp", "l_orderkey", "value", "decimals", "usual")


@query("""WITH c AS (SELECT o_orderkey AS doc_id, CASE o_orderkey % 5 WHEN 0 THEN ' ' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || ' ' WHEN 1 THEN '1e3' WHEN 2 THEN CAST(CAST(o_totalprice AS DECIMAL(18,1)) AS VARCHAR) || ' mm' WHEN 3 THEN '-' || o_orderkey ELSE replace(CAST(CAST(o_totalprice AS DECIMAL(18,3)) AS VARCHAR), '.', ',') END AS raw FROM orders)
    SELECT doc_id, raw, CASE WHEN regexp_full_match(raw, '\\s*-?[0-9]+([.][0-9]+)?\\s*') THEN CAST(trim(raw) AS DOUBLE) END AS number FROM c""")
def exact_number(spark: Spark, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    m, price = F.col("o_orderkey") % 5, lambda n: F.col("o_totalprice").cast(f"decimal(18,{n})").cast("string")
    raw = F.when(m == 0, F.concat(F.lit(" "), price(2), F.lit(" "))).when(m == 1, "1e3").when(m == 2, F.concat(price(1), F.lit(" mm"))).when(m == 3, F.concat(F.lit("-"), "o_orderkey")).otherwise(F.replace(price(3), F.lit("."), F.lit(",")))
    rows = o.select(F.col("o_orderkey").alias("doc_id"), raw.alias("raw"))
    return rows.withColumn("number", X.exact(F.col("raw")).cast("double"))


@query("""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark), c(choice) AS (VALUES ('there'), ('nation'), ('other'), ('thing'), ('stand'), ('ering'), ('inter'))
    SELECT word, choice FROM w, c WHERE length(word) >= 5 AND levenshtein(word, choice) <= 1""")
def fuzzy_one_edit(spark: Spark, d: str) -> DataFrame:
    return quality.one_edit(benchmark_words(spark, d), choices(spark))


def benchmark_words(spark: Spark, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("word"))


def choices(spark: Spark) -> DataFrame:
    return spark.createDataFrame([(w,) for w in ("there", "nation", "other", "thing", "stand", "ering", "inter")], "choice string")


@query()
def fuzzy_match(spark: Spark, d: str) -> DataFrame:
    """The whole closed-set match; the ratio of alike runs has no SQL twin."""
    return quality.closest(benchmark_words(spark, d), choices(spark))


@query("""WITH m AS (SELECT l_suppkey, greatest(15.0, 4 * median(l_discount * l_quantity)) AS upper FROM lineitem GROUP BY 1)
    SELECT l_orderkey, l.l_suppkey, l_discount * l_quantity AS ink, upper FROM lineitem l JOIN m ON m.l_suppkey = l.l_suppkey WHERE l_discount * l_quantity > upper""")
def robust_outlier(spark: Spark, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", (F.col("l_discount") * F.col("l_quantity")).alias("ink"))
    return quality.robust_outliers(rows, "l_suppkey", "ink").select("l_orderkey", "l_suppkey", "ink", "upper")


@query("""SELECT l_orderkey, l_linenumber, arg_min(l_returnflag, (l_partkey, l_suppkey, l_returnflag)) AS text, count(DISTINCT l_returnflag) > 1 AS conflict, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def dedupe_keep_first(spark: Spark, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "text")
    return quality.keep_first(rows, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"], "text")


@query("SELECT DISTINCT sha256(text) AS key FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en')")
def missing_in_cache(spark: Spark, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("key", F.sha2("text", 256))
    return store.missing_from(docs.select("key"), docs.filter("lang = 'en'").select("key"), "key")


@query("""SELECT l_orderkey, l_linenumber, 1.0::DOUBLE - l_discount * 1.5::DOUBLE AS score FROM lineitem WHERE 1.0::DOUBLE - l_discount * 1.5::DOUBLE < 0.9::DOUBLE""")
def low_confidence(spark: Spark, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("score", F.lit(1.0) - F.col("l_discount") * 1.5)
    return quality.low_confidence(rows).select("l_orderkey", "l_linenumber", "score")


@query("""WITH c AS (SELECT o_orderkey AS cell, CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'l2.3' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS text, o_orderkey % 4 AS n_items, 0.85 + (o_orderkey % 10) / 100.0 AS score FROM orders)
    SELECT cell, array_to_string(list_filter([CASE WHEN text = '' THEN 'empty' END, CASE WHEN text <> '' AND n_items > 1 THEN 'several pieces' END, CASE WHEN text <> '' AND NOT regexp_full_match(text, '-?[0-9]+([.][0-9]+)?') THEN 'not a number' END,
        CASE WHEN text <> '' AND score < 0.9 THEN 'low score' END], lambda x: x IS NOT NULL), ',') AS problems FROM c""")
def cell_checks(spark: Spark, d: str) -> DataFrame:
    o, m = table(spark, d, "orders"), F.col("o_orderkey")
    text = F.when(m % 6 == 0, "").when(m % 6 == 1, "l2.3").otherwise(T.money("o_totalprice"))
    score = (F.lit("0.85").cast("decimal(4,2)") + (m % 10).cast("decimal(4,2)") / 100).cast("decimal(6,4)")
    cells = o.select(m.alias("cell"), text.alias("text"), (m % 4).alias("n_items"), score.alias("score"), F.lit(True).alias("numeric"), F.lit(True).alias("single"))
    return quality.cell_problems(cells).select("cell", F.array_join("problems", ",").alias("problems"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, id ORDER BY l_partkey, l_suppkey, l_extendedprice) AS nth FROM (SELECT *, CASE WHEN l_linenumber = 7 THEN ' ' ELSE 'r' || l_linenumber END AS id FROM lineitem))
    SELECT l_orderkey, id, l_partkey, CASE WHEN trim(id) = '' THEN 'no id' WHEN nth > 1 THEN 'repeated id' WHEN NOT l_quantity BETWEEN 1 AND 40 THEN 'no such page' ELSE 'ok' END AS verdict FROM r""")
def reply_validation(spark: Spark, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("id", F.when(F.col("l_linenumber") == 7, " ").otherwise(F.concat(F.lit("r"), "l_linenumber")))
    return quality.validated(rows, ["l_orderkey"], ["l_partkey", "l_suppkey", "l_extendedprice"], "id", "l_quantity", 40).select("l_orderkey", "id", "l_partkey", "verdict")


@query("""SELECT o_custkey AS doc, min(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END) AS F, min(CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END) AS O, min(CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END) AS P,
    array_to_string(list_filter([CASE WHEN count(*) FILTER (o_orderstatus = 'F') = 0 THEN 'F' END, CASE WHEN count(*) FILTER (o_orderstatus = 'O') = 0 THEN 'O' END, CASE WHEN count(*) FILTER (o_orderstatus = 'P') = 0 THEN 'P' END], lambda x: x IS NOT NULL), ',') AS missing
    FROM orders GROUP BY o_custkey""")
def required_fields(spark: Spark, d: str) -> DataFrame:
    pairs = table(spark, d, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderstatus").alias("label"), F.col("o_orderpriority").alias("value"))
    return quality.required(pairs, "doc", ["F", "O", "P"]).withColumn("missing", F.array_join("missing", ","))


@query("""SELECT coalesce(a.o_custkey, b.c_custkey) AS doc, n, c_name AS recommendation, CASE WHEN n IS NULL THEN 'extra recommendation' WHEN c_name IS NULL THEN 'no recommendation' ELSE 'ok' END AS status
    FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 <> 0) b ON a.o_custkey = b.c_custkey""")
def evidence_assembly(spark: Spark, d: str) -> DataFrame:
    a = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("doc")).agg(F.count("*").alias("n"))
    b = table(spark, d, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("doc"), F.col("c_name").alias("recommendation"))
    return quality.assemble(a, b, ["doc"])


@query(f"""WITH {READINGS}, fresh AS (SELECT * FROM readings WHERE doc_id % 10 = 0 AND item % 2 = 0)
    SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM readings WHERE doc_id NOT IN (SELECT doc_id FROM fresh) UNION ALL SELECT doc_id FROM fresh) GROUP BY doc_id""")
def replace_by_key(spark: Spark, d: str) -> DataFrame:
    rows = T.readings(spark, d)
    return store.replace_by_key(rows, rows.filter("doc_id % 10 = 0 and item % 2 = 0")).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"""WITH {READINGS} SELECT doc_id, '[' || coalesce(string_agg('{{"cml_id":"' || cml_id || '","current_mm":"' || cur || '","min_required_mm":"' || least || '"}}', ',' ORDER BY cml_id, CAST(cur AS VARCHAR), CAST(least AS VARCHAR)) FILTER (review_status <> 'needs review'), '') || ']' AS rows,
    count(*) FILTER (review_status = 'needs review') AS held FROM readings GROUP BY doc_id""")
def snapshot_export(spark: Spark, d: str) -> DataFrame:
    return store.snapshot(T.readings(spark, d))
