"""Queries over logs, claims and scores, and batch twins of the event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.operators import audit, checks, scoring
from proofline.plans.registry import query
from proofline.plans.storage import place
from proofline.sources import tables as T
from proofline.sources.tables import FINDINGS, READINGS, table
from proofline.streaming import events as E

Spark = SparkSession
LINE = "event_id || '|' || event_type || '|' || user_id"


def chained(spark: Spark, d: str) -> DataFrame:
    log = table(spark, d, "events").withColumn("log", F.col("user_id") % 50)
    return audit.chain(log, "log", "event_id", F.concat_ws("|", "event_id", "event_type", "user_id"))


@query(f"SELECT user_id % 50 AS log, event_id, coalesce(lag(sha256({LINE})) OVER (PARTITION BY user_id % 50 ORDER BY event_id), repeat('0', 64)) AS prev_sha256 FROM events")
def chain_build(spark: Spark, d: str) -> DataFrame:
    return chained(spark, d).select("log", "event_id", "prev_sha256")


JSON_LINE = """'{"e":' || event_id || ',"u":' || user_id || '}'"""


@query(f"""WITH l AS (SELECT user_id % 50 AS log, event_id, {JSON_LINE} AS good, CASE WHEN event_id % 97 = 0 THEN '' WHEN event_id % 101 = 0 THEN '{{broken' WHEN event_id % 103 = 0 THEN '{{"e":0}}' ELSE {JSON_LINE} END AS line FROM events),
    s AS (SELECT *, coalesce(lag(sha256(good)) OVER (PARTITION BY log ORDER BY event_id), repeat('0', 64)) AS stored FROM l WHERE event_id % 97 <> 0),
    c AS (SELECT *, row_number() OVER (PARTITION BY log ORDER BY event_id) AS nth, coalesce(lag(sha256(line)) OVER (PARTITION BY log ORDER BY event_id), repeat('0', 64)) AS want FROM s)
    SELECT log, count(*) AS n, CAST(min(CASE WHEN line = '{{broken' OR stored <> want THEN nth END) AS INTEGER) AS broken_at FROM c GROUP BY log""")
def chain_verify(spark: Spark, d: str) -> DataFrame:
    n = F.col("event_id")
    good = F.concat(F.lit('{"e":'), n, F.lit(',"u":'), "user_id", F.lit("}"))
    log = table(spark, d, "events").withColumn("log", F.col("user_id") % 50)
    chain = audit.chain(log.filter("event_id % 97 <> 0"), "log", "event_id", good)
    blank = log.filter("event_id % 97 = 0").select("log", "event_id", F.lit(" ").alias("line"), F.lit(None).cast("string").alias("prev_sha256"))
    line = F.when(n % 101 == 0, "{broken").when(n % 103 == 0, '{"e":0}').otherwise(F.col("line"))
    return audit.breaks(chain.withColumn("line", line).unionByName(blank), "log", "event_id")


@query("SELECT o_custkey AS doc_id, sha256(string_agg(part, chr(10) ORDER BY part)) AS sha256 FROM (SELECT o_custkey, o_orderkey || '|' || coalesce(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END, '<null>') AS part FROM orders) GROUP BY 1")
def fingerprint(spark: Spark, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("p"))
    return audit.fingerprint(rows, "doc_id", "o_orderkey", "p")


@query(f"WITH {FINDINGS} SELECT doc_id, severity, count(*) AS n FROM findings GROUP BY 1, 2")
def severity_counts(spark: Spark, d: str) -> DataFrame:
    return T.findings(spark, d).groupBy("doc_id", "severity").agg(F.count("*").alias("n"))


TOLD = """told AS (SELECT o_custkey AS doc_id, 'The report has ' || CASE WHEN o_custkey % 3 = 0 THEN 'two' ELSE CAST(count(*) FILTER (o_orderpriority = '2-HIGH') AS VARCHAR) END || ' major findings – total ' || CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS VARCHAR) || ' mm or 3 inch.'
    || CASE WHEN o_custkey % 4 = 0 THEN ' It is approved for service.' ELSE '' END || ' Reading is below the minimum.' AS text, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS VARCHAR) AS total, count(*) FILTER (o_orderpriority = '2-HIGH') AS high FROM orders GROUP BY o_custkey)"""


def told(spark: Spark, d: str) -> DataFrame:
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(38,2)").cast("string")
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(total.alias("total"), F.count_if(F.col("o_orderpriority") == "2-HIGH").alias("high"))
    said = F.when(F.col("doc_id") % 3 == 0, "two").otherwise(F.col("high").cast("string"))
    verdict = F.when(F.col("doc_id") % 4 == 0, " It is approved for service.").otherwise("")
    return rows.withColumn("text", F.concat(F.lit("The report has "), said, F.lit(" major findings – total "), "total", F.lit(" mm or 3 inch."), verdict, F.lit(" Reading is below the minimum.")))


@query(f"WITH {TOLD} SELECT DISTINCT doc_id, number FROM (SELECT doc_id, total, unnest(regexp_extract_all(text, '\\d+(?:\\.\\d+)?')) AS number FROM told) WHERE number <> total")
def number_claims(spark: Spark, d: str) -> DataFrame:
    rows = told(spark, d)
    return checks.unknown_numbers(rows, rows.select("doc_id", F.col("total").alias("form")))


@query(f"WITH {TOLD} SELECT doc_id, 'major' AS severity, CAST(2 AS BIGINT) AS said, high AS there FROM told WHERE doc_id % 3 = 0 AND high <> 2")
def count_claims(spark: Spark, d: str) -> DataFrame:
    rows = told(spark, d)
    return checks.wrong_counts(rows, rows.filter("high > 0").select("doc_id", F.lit("major").alias("severity"), F.col("high").alias("n")))


@query(f"WITH {TOLD} SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'verdict,unit' ELSE 'unit' END || CASE WHEN len(string_split_regex(trim(text), '\\s+')) > 18 THEN ',too long' ELSE '' END AS problems FROM told")
def summary_checks(spark: Spark, d: str) -> DataFrame:
    return told(spark, d).select("doc_id", F.array_join(checks.said_wrongly(F.col("text"), 18), ",").alias("problems"))


@query(f"WITH {TOLD} SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 1 END AS nth, 'Reading is below the minimum.' AS sentence FROM told")
def breach_claims(spark: Spark, d: str) -> DataFrame:
    return checks.breach_claims(checks.sentences(told(spark, d).select("doc_id", "text")))


@query("""WITH c AS (SELECT doc_id AS claim_id, 'it holds ' || n_chars || ' signs and 1,234 parts' AS text, [doc_id, doc_id + 1] AS cited FROM documents), p AS (SELECT doc_id AS passage_id, 'length ' || (n_chars + doc_id % 2) || ' of ' || CASE WHEN doc_id % 3 = 0 THEN '1234' ELSE '99' END AS text FROM documents),
    s AS (SELECT DISTINCT claim_id, replace(unnest(regexp_extract_all(text, '\\d[\\d,]*(?:\\.\\d+)?')), ',', '') AS number FROM c),
    t AS (SELECT DISTINCT claim_id, replace(unnest(regexp_extract_all(p.text, '\\d[\\d,]*(?:\\.\\d+)?')), ',', '') AS number FROM (SELECT claim_id, unnest(cited) AS passage_id FROM c) JOIN p USING (passage_id))
    SELECT claim_id, number FROM s WHERE (claim_id, number) NOT IN (SELECT claim_id, number FROM t)""")
def grounding(spark: Spark, d: str) -> DataFrame:
    docs, n = table(spark, d, "documents"), F.col("doc_id")
    claims = docs.select(n.alias("claim_id"), F.concat(F.lit("it holds "), "n_chars", F.lit(" signs and 1,234 parts")).alias("text"), F.array(n, n + 1).alias("cited"))
    passages = docs.select(n.alias("passage_id"), F.concat(F.lit("length "), F.col("n_chars") + n % 2, F.lit(" of "), F.when(n % 3 == 0, "1234").otherwise("99")).alias("text"))
    return checks.ungrounded(claims, passages)


STEPS = """st AS (SELECT o_custkey AS plan_id, o_orderkey AS nth, CASE o_orderpriority WHEN '1-URGENT' THEN 'inspect' WHEN '2-HIGH' THEN 'search' WHEN '3-MEDIUM' THEN 'write' ELSE o_orderpriority END AS kind, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderstatus END AS arg FROM orders)"""


def steps(spark: Spark, d: str) -> DataFrame:
    p = F.col("o_orderpriority")
    kind = F.when(p == "1-URGENT", "inspect").when(p == "2-HIGH", "search").when(p == "3-MEDIUM", "write").otherwise(p)
    return table(spark, d, "orders").select(F.col("o_custkey").alias("plan_id"), F.col("o_orderkey").alias("nth"), kind.alias("kind"), F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.col("o_orderstatus")).alias("arg"))


@query(f"""WITH {STEPS} SELECT DISTINCT plan_id, 'unknown kind: ' || kind AS problem FROM st WHERE kind NOT IN ('inspect', 'search', 'write')
    UNION SELECT plan_id, 'no argument: ' || kind FROM st WHERE kind IN ('inspect', 'search') AND arg = '' UNION SELECT plan_id, 'repeated: ' || kind FROM st WHERE kind IN ('inspect', 'search', 'write') GROUP BY plan_id, kind, CASE WHEN kind = 'write' THEN '' ELSE trim(arg) END HAVING count(*) > 1
    UNION SELECT plan_id, 'too many steps' FROM st GROUP BY plan_id HAVING count(*) > 15""")
def plan_check(spark: Spark, d: str) -> DataFrame:
    kinds = spark.createDataFrame([("inspect", True), ("search", True), ("write", False)], "kind string, needs_arg boolean")
    return checks.plan_problems(steps(spark, d), kinds, 15)


@query("""WITH n AS (SELECT o_orderkey AS id, CAST(o_totalprice AS DECIMAL(18,2)) AS cur, o_orderstatus AS status FROM orders), m AS (SELECT id, CASE WHEN id % 7 = 0 THEN cur + 1 ELSE cur END AS cur, CASE WHEN id % 11 = 0 THEN 'X' ELSE status END AS status FROM n WHERE id % 13 <> 0),
    j AS (SELECT n.id, m.id IS NOT NULL AS p, m.cur IS NOT NULL AND m.cur = n.cur AS c, m.status IS NOT NULL AND m.status = n.status AS s FROM n LEFT JOIN m ON n.id = m.id)
    SELECT id, 'present' AS "check", p AS ok FROM j UNION ALL SELECT id, 'cur', c FROM j UNION ALL SELECT id, 'status', s FROM j""")
def readback_diff(spark: Spark, d: str) -> DataFrame:
    i = F.col("id")
    truth = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("decimal(18,2)").alias("cur"), F.col("o_orderstatus").alias("status"))
    note = truth.filter("id % 13 <> 0").select("id", F.when(i % 7 == 0, F.col("cur") + 1).otherwise(F.col("cur")).cast("decimal(18,2)").alias("cur"), F.when(i % 11 == 0, "X").otherwise(F.col("status")).alias("status"))
    return scoring.readback(note, truth, ["id"], ["cur", "status"])


def fields(spark: Spark, d: str) -> tuple[DataFrame, DataFrame]:
    i = F.col("id")
    want = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.explode(F.array(F.struct(F.lit("price").alias("field"), T.money("o_totalprice").alias("value")), F.struct(F.lit("status").alias("field"), F.col("o_orderpriority").alias("value")))).alias("f")).select("id", "f.*")
    value = F.when(i % 7 == 0, "12.5").when((i % 5 == 0) & (F.col("field") == "status"), F.concat(F.lit("  "), F.lower("value"))).when((i % 3 == 0) & (F.col("field") == "price"), F.concat("value", F.lit("0"))).otherwise(F.col("value"))
    got = want.filter("id % 13 <> 0").withColumn("value", value).withColumn("flagged", i % 2 == 0)
    extra = want.filter("id % 17 = 0 and id > 0 and field = 'price'").select((-i).alias("id"), "field", "value", F.lit(False).alias("flagged"))
    return got.unionByName(extra), want


FIELDS = """fs AS (SELECT o_orderkey AS id, field, CASE WHEN o_orderkey % 13 = 0 THEN 'missing' WHEN o_orderkey % 7 = 0 AND NOT (field = 'price' AND CAST(o_totalprice AS DECIMAL(18,2)) = 12.5) THEN CASE WHEN o_orderkey % 2 = 0 THEN 'caught' ELSE 'wrong' END ELSE 'right' END AS verdict
    FROM orders, (VALUES ('price'), ('status')) f(field) UNION ALL SELECT -o_orderkey, 'price', 'extra' FROM orders WHERE o_orderkey % 17 = 0 AND o_orderkey > 0)"""


@query(f"WITH {FIELDS} SELECT id, field, verdict FROM fs")
def field_score(spark: Spark, d: str) -> DataFrame:
    return scoring.field_score(*fields(spark, d), ["id"])


@query(f"""WITH {FIELDS} SELECT field, count(*) FILTER (verdict = 'right') AS "right", count(*) FILTER (verdict = 'caught') AS caught, count(*) FILTER (verdict = 'wrong') AS wrong, count(*) FILTER (verdict = 'missing') AS missing, count(*) FILTER (verdict = 'extra') AS extra FROM fs GROUP BY ROLLUP (field)""")
def field_totals(spark: Spark, d: str) -> DataFrame:
    return scoring.score_totals(scoring.field_score(*fields(spark, d), ["id"]), "field")


@query(f"""WITH {READINGS}, r AS (SELECT doc_id, cml_id || '-' || cur AS cml_id, cur < least AS breached FROM readings), k(name) AS (VALUES ('banner'), ('outcome'), ('findings'), ('ids'), ('placeholders'), ('sign-off'))
    SELECT doc_id, 'row' AS "check", cml_id AS subject, false AS ok FROM r WHERE doc_id % 13 = 0
    UNION ALL SELECT doc_id, 'values', cml_id, doc_id % 7 <> 0 FROM r WHERE doc_id % 13 <> 0
    UNION ALL SELECT doc_id, 'status', cml_id, doc_id % 11 <> 0 OR breached FROM r WHERE doc_id % 13 <> 0
    UNION ALL SELECT o_orderkey, name, NULL, CASE name WHEN 'banner' THEN o_orderkey % 14 <> 0 WHEN 'outcome' THEN o_orderkey % 15 <> 0 WHEN 'findings' THEN o_orderkey % 9 > 2 WHEN 'ids' THEN o_orderkey % 8 <> 0 WHEN 'placeholders' THEN o_orderkey % 12 > 2 ELSE o_orderkey % 16 > 1 END FROM orders, k""")
def note_readback(spark: Spark, d: str) -> DataFrame:
    """Notes with all kinds of faults: rows gone, values and grades changed, words of the template left in."""
    i, evidence = F.col("doc_id"), lambda c: F.concat("doc_id", F.lit(":"), c)
    r = T.readings(spark, d).select("doc_id", F.concat_ws("-", "cml_id", "current_mm").alias("cml_id"), F.col("current_mm").alias("current"), F.col("min_required_mm").alias("minimum"))
    path = place(spark)
    r.write.parquet(f"{path}/readings")
    short_of = F.col("current").cast("decimal(18,2)") < F.col("minimum").cast("decimal(18,2)")
    kept = spark.read.parquet(f"{path}/readings")  # what can be worked out of a row is neither stored nor sent
    readings = kept.withColumn("breached", short_of).withColumn("evidence_id", evidence("cml_id"))
    status = F.when(F.col("breached") | (i % 11 == 0), " BELOW MIN").otherwise("OK ")
    rows = readings.filter("doc_id % 13 <> 0").select("doc_id", "cml_id", F.when(i % 7 == 0, F.concat("current", F.lit("0"))).otherwise(F.col("current")).alias("current"), "minimum", status.alias("status"))
    findings = T.report_findings(spark, d).select("doc_id", "finding_id", "severity").withColumn("evidence_id", evidence("finding_id"))
    told = findings.filter("doc_id % 9 <> 0").select("doc_id", F.explode(F.when(i % 9 == 1, F.array("finding_id", F.lit("F-new"))).otherwise(F.array("finding_id"))).alias("finding_id"), F.when(i % 9 == 2, "Unknown").otherwise(F.col("severity")).alias("severity"))
    named = kept.select("doc_id", F.col("cml_id").alias("name")).unionByName(findings.filter("doc_id % 8 <> 0").select("doc_id", F.col("finding_id").alias("name")))
    listed = named.groupBy("doc_id").agg(F.array_join(F.transform(F.collect_list("name"), evidence), "\n").alias("ids"))
    left = F.when(i % 12 == 0, "[Insert name]").when(i % 12 == 1, "{{x").when(i % 12 == 2, "[listing of things]").otherwise("[1] {x}")
    notes = findings.select("doc_id").join(listed, "doc_id", "left").select(
        "doc_id", F.when(i % 14 == 0, "DRAFT").otherwise(f"{scoring.BANNER} 1").alias("header"), left.alias("body"),
        F.concat_ws("\n", F.when(i % 15 == 0, "RULES OUTCOME: approve").otherwise("RULES OUTCOME: reject"), "ids").alias("cells"),
        F.when(i % 16 == 0, F.array(F.lit(""), F.lit("A. Name"))).when(i % 16 > 1, F.array(F.lit(" "), F.lit(""))).alias("signoff"), F.lit("reject").alias("outcome"),
    )
    return scoring.note_checks(notes, rows, readings, told, findings)


@query("""WITH o AS (SELECT o_orderkey AS k, k % 7 = 1 AS price, k % 5 = 0 AS status, k % 9 AS f, k % 11 AS r, CAST(CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END AS BIGINT) AS new FROM orders)
    SELECT k AS doc_id, CAST(8 AS BIGINT) AS fields, price::BIGINT + status::BIGINT + CASE f WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END + CASE WHEN r <= 2 THEN 1 ELSE 0 END + new AS errors, CAST(5 AS BIGINT) AS critical_fields, CASE WHEN f <= 1 THEN 1 ELSE 0 END + CASE WHEN r <= 1 THEN 1 ELSE 0 END + new AS critical_errors FROM o""")
def page_score(spark: Spark, d: str) -> DataFrame:
    """Reports read whole, with values wrong, rows gone and rows invented; other ways to print the same value are right."""
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").withColumn("price", T.money("o_totalprice"))
    cell = lambda part, row, field, value, number: F.struct(F.lit(part).alias("part"), F.lit(row).alias("row"), F.lit(field).alias("field"), value.cast("string").alias("value"), F.lit(number).alias("number"))
    price, words = F.col("price"), F.lit("In  use – 20 °C")
    truth = o.select(k.alias("doc_id"), F.inline(F.array(
        cell("header", "", "price", price, True), cell("header", "", "status", words, False),
        cell("finding", "F-1", "severity", F.lit("Major"), False), cell("finding", "F-1", "description", words, False),
        *[c for n in "12" for c in (cell("reading", n, "location", F.lit(f"Shell {n}"), False), cell("reading", n, "current_mm", price, True))],
    )))
    more = (o["o_totalprice"].cast("decimal(18,2)") + 1).cast("decimal(18,2)")
    read = o.select(k.alias("doc_id"), F.inline(F.filter(F.array(
        cell("header", "", "price", F.when(k % 7 == 0, F.concat(price, F.lit(" mm"))).when(k % 7 == 1, more.cast("string")).when(k % 7 == 2, F.concat(price, F.lit("0"))).otherwise(price), True),
        cell("header", "", "status", F.when(k % 5 == 0, "other").otherwise(" in use - 20 DEGC "), False),
        *[F.when(k % 9 != 0, c) for c in (cell("finding", "F-1", "severity", F.when(k % 9 == 1, "Minor").otherwise("MAJOR"), False), cell("finding", "F-1", "description", F.when(k % 9 == 2, "In use").otherwise(words), False))],
        *[F.when(k % 11 != 0, c) for c in (cell("reading", "1", "location", F.lit("shell 1"), False), cell("reading", "1", "current_mm", price, True))],
        cell("reading", "2", "location", F.when(k % 11 == 2, "Head").otherwise("Shell 2"), False), cell("reading", "2", "current_mm", F.when(k % 11 == 1, more.cast("string")).otherwise(price), True),
        *[F.when(k % 13 == 0, c) for c in (cell("finding", "F-9", "severity", F.lit("Minor"), False), cell("reading", "9", "location", F.lit("Head"), False))],
    ), lambda c: c.isNotNull())))
    return scoring.page_score(read.drop("number"), truth)


@query("""SELECT l_orderkey AS doc_id, CASE WHEN bool_or(l_partkey % 4 = 0) THEN 'right stop' ELSE 'false alarm' END AS verdict, count(*) FILTER (l_partkey % 4 = 0) AS n_wrong FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1""")
def stop_classes(spark: Spark, d: str) -> DataFrame:
    want = T.money("l_extendedprice")
    got = F.when(F.col("l_partkey") % 8 == 0, F.lit(None).cast("string")).when(F.col("l_partkey") % 8 == 4, F.concat(F.lit("1"), want)).otherwise(F.concat(want, F.lit("0")))
    flags = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("doc_id"), got.alias("got"), want.alias("want"))
    return scoring.stop_classes(flags)


@query("""WITH h AS (SELECT l_orderkey AS query_id, l_partkey AS doc_id, min(l_linenumber) AS rank0 FROM lineitem WHERE l_linenumber <= 5 GROUP BY 1, 2), e AS (SELECT DISTINCT l_orderkey AS query_id, l_partkey AS doc_id FROM lineitem WHERE l_suppkey % 3 = 0)
    SELECT e.query_id, min(rank0) AS found_at, bool_and(rank0 IS NOT NULL) AS all_found FROM e LEFT JOIN h USING (query_id, doc_id) GROUP BY 1""")
def retrieval_score(spark: Spark, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("doc_id"), "l_linenumber", "l_suppkey")
    hits = li.filter("l_linenumber <= 5").groupBy("query_id", "doc_id").agg(F.min("l_linenumber").alias("rank0"))
    return scoring.retrieval_score(hits, li.filter("l_suppkey % 3 = 0").select("query_id", "doc_id").distinct())


@query("""SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS correct, round(count(*) FILTER (quality = 1) / count(*), 3) AS rate, median(n_chars) AS median_seconds FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)""")
def verdict_summary(spark: Spark, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").withColumn("kind", F.when(F.col("quality") == 1, "correct").otherwise("wrong"))
    return scoring.verdict_summary(rows, "lang", "kind", "n_chars")


@query("""WITH a AS (SELECT l_returnflag AS kind, l_linenumber AS arg, count(*) AS n FROM lineitem GROUP BY 1, 2), b AS (SELECT l_returnflag AS kind, l_linenumber AS arg, count(*) AS n FROM lineitem WHERE l_partkey % 2 = 0 OR l_linestatus = 'O' GROUP BY 1, 2),
    j AS (SELECT kind, arg, coalesce(a.n, 0) - coalesce(b.n, 0) AS diff FROM a FULL JOIN b USING (kind, arg)) SELECT kind, arg, greatest(diff, 0) AS extra, greatest(-diff, 0) AS missing FROM j WHERE diff <> 0""")
def multiset_diff(spark: Spark, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("kind"), F.col("l_linenumber").alias("arg"), "l_partkey", "l_linestatus")
    return scoring.multiset_difference(li, li.filter("l_partkey % 2 = 0 or l_linestatus = 'O'"), ["kind", "arg"])


@query("SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_daily(spark: Spark, d: str) -> DataFrame:
    return E.daily(E.with_event_time(table(spark, d, "events"))).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT event_id, event_type, user_id FROM events WHERE event_id > 5000")
def event_replay(spark: Spark, d: str) -> DataFrame:
    return E.replay(table(spark, d, "events"), 5000).select("event_id", "event_type", "user_id")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS nth FROM events) WHERE nth <= 2")
def latest_events(spark: Spark, d: str) -> DataFrame:
    return E.latest(table(spark, d, "events"), "user_id", 2).select("user_id", "event_id")
