"""Queries over what models and people say: summaries, replies, answers, plans and reviews against facts.

The twins know from the row's number what its text says, so they share no pattern with the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.functions.sizes import spread
from proofline.operators import checks, retrieval, rules
from proofline.plans.registry import query
from proofline.plans.storage import place
from proofline.sources.tables import money, table

Spark = SparkSession


def orders(spark: Spark, d: str) -> DataFrame:
    """doc_id, least, cur: a minimum and a larger measured value of each order, as printed."""
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("doc_id"), money("o_totalprice").alias("least"), (F.col("o_totalprice").cast("decimal(18,2)") + 1).cast("decimal(18,2)").cast("string").alias("cur"))


PRICED = "pr AS (SELECT o_orderkey AS doc_id, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS least, CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) + 1 AS DECIMAL(18,2)) AS VARCHAR) AS cur FROM orders)"


@query(f"""WITH {PRICED} SELECT doc_id, cur AS number, 'minimum' AS said FROM pr WHERE doc_id % 5 IN (1, 3) UNION ALL SELECT doc_id, least, 'measured' FROM pr WHERE doc_id % 5 IN (1, 4)""")
def role_claims(spark: Spark, d: str) -> DataFrame:
    """Minimums given as measured values, and the other way round."""
    rows, m = orders(spark, d), F.col("doc_id") % 5
    text = (
        F.when(m == 1, F.concat(F.lit("The minimum required is "), "cur", F.lit(" mm. It measures "), "least", F.lit(" mm.")))
        .when(m == 2, F.concat(F.lit("The minimum measured thickness was "), "cur", F.lit(" mm.")))
        .when(m == 3, F.concat(F.lit("An allowable value of "), "cur", F.lit(" mm is given.")))
        .when(m == 4, F.concat(F.lit("A reading of "), "least", F.lit(" mm was taken.")))
        .otherwise(F.concat(F.lit("Min. "), "least", F.lit(" mm, currently "), "cur", F.lit(" mm.")))
    )
    values = rows.select("doc_id", F.explode(F.array(F.struct(F.col("least").alias("form"), F.lit(True).alias("minimum")), F.struct(F.col("cur").alias("form"), F.lit(False).alias("minimum")))).alias("v")).select("doc_id", "v.*")
    return checks.swapped_roles(rows.select("doc_id", text.alias("text")), values)


@query("""WITH o AS (SELECT o_orderkey AS doc_id FROM orders)
    SELECT doc_id, 'does not mention CML-2' AS problem FROM o WHERE doc_id % 3 = 0 AND doc_id % 4 NOT IN (0, 3)
    UNION ALL SELECT doc_id, 'says below minimum: CML-1' FROM o WHERE doc_id % 4 IN (1, 2)
    UNION ALL SELECT doc_id, 'says below minimum: CML-2' FROM o WHERE doc_id % 4 = 0 AND doc_id % 3 <> 0
    UNION ALL SELECT doc_id, 'claims a breach that was not found' FROM o WHERE doc_id % 4 = 3 AND doc_id % 3 <> 0""")
def breach_evidence(spark: Spark, d: str) -> DataFrame:
    """What summaries say of breaches against each report's own readings: CML-1 (north shell) is fine, CML-2 (floor) is not in every third report."""
    o, m = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id")), F.col("doc_id") % 4
    o = spread(o, o.count(), "doc_id")
    text = (
        F.when(m == 0, "All is read. CML-2 falls short of its required value! Done.")
        .when(m == 1, "CML-1 is below the minimum. More follows.")
        .when(m == 2, "The North Shell violates the allowable thickness. More follows.")
        .otherwise("One part is below the minimum. CML-2 was read. CML-1 is well above its minimum.")
    )
    reading = lambda n, place, bad: F.struct(F.lit(n).alias("cml_id"), F.lit(place).alias("location"), bad.alias("breached"))
    readings = o.select("doc_id", F.inline(F.array(reading("CML-1", "north shell", F.lit(False)), reading("CML-2", "floor", F.col("doc_id") % 3 == 0))))
    return checks.breach_problems(o.select("doc_id", text.alias("text")), readings)


@query("""SELECT event_id, CASE WHEN event_id % 8 = 0 THEN 'empty' ELSE array_to_string(list_filter([CASE WHEN event_id % 8 = 1 THEN 'verdict' END, CASE WHEN event_id % 8 IN (1, 2) THEN 'names DOC-7, TK-101' WHEN event_id % 8 = 3 THEN 'names TK-101' END,
    CASE WHEN event_id % 8 = 4 THEN 'claims work' END, CASE WHEN event_id % 8 = 5 THEN 'too long' END], lambda x: x IS NOT NULL), '; ') END AS problems FROM events""")
def chat_reply_check(spark: Spark, d: str) -> DataFrame:
    """Chat replies: verdicts, own documents named as whole tokens, claims of work, length."""
    m = F.col("event_id") % 8
    text = (
        F.when(m == 0, " ")
        .when(m == 1, "DOC-7 says that tk-101 is approved")
        .when(m == 2, "See doc-7 and TK-101, not TK-1011 or XTK-101")
        .when(m == 3, "The tank TK‑101 is one")
        .when(m == 4, "I've already checked it")
        .when(m == 5, F.repeat(F.lit("word "), 91))
        .when(m == 6, F.repeat(F.lit("word "), 90))
        .otherwise("I can read a report and write a note for TK-1012")
    )
    rows = table(spark, d, "events").select("event_id", text.alias("text"))
    # patterns of fixed names are made once, not for each row
    plain = rows.withColumn("plain", checks.plain(F.col("text")))
    names = F.array_compact(F.array(*[F.when(checks.names_token(F.col("plain"), F.lit(n)), n) for n in ("DOC-7", "TK-101")]))
    return plain.withColumn("names", names).select("event_id", F.array_join(checks.reply_problems(F.col("plain"), F.col("names")), "; ").alias("problems"))


@query("""WITH a AS (SELECT doc_id AS answer_id FROM documents) SELECT answer_id, 1 AS nth, 'cites no passage' AS problem FROM a WHERE answer_id % 7 = 0 UNION ALL SELECT answer_id, 1, 'cites: P9' FROM a WHERE answer_id % 7 IN (1, 2)
    UNION ALL SELECT answer_id, 1, 'names: STD-99' FROM a WHERE answer_id % 7 = 3 UNION ALL SELECT answer_id, 1, 'number: 13' FROM a WHERE answer_id % 7 = 3
    UNION ALL SELECT answer_id, 1, 'names: Menon' FROM a WHERE answer_id % 7 = 4 UNION ALL SELECT answer_id, 1, 'names: Dr' FROM a WHERE answer_id % 7 = 4 UNION ALL SELECT answer_id, 1, 'names: Whoever' FROM a WHERE answer_id % 7 = 4 UNION ALL SELECT answer_id, 1, 'quotes: shall be tested yearly' FROM a WHERE answer_id % 7 = 5""")
def answer_grounding(spark: Spark, d: str) -> DataFrame:
    """Sentences of answers against the passages that they cite: identifiers, names, numbers, quotes."""
    docs, m = table(spark, d, "documents").select(F.col("doc_id").alias("answer_id")), F.col("answer_id") % 7
    text = (
        F.when(m.isin(0, 1, 2), "The valve is tested at 1,500 hours under STD-12 Cl. 4")
        .when(m == 3, "STD-99 asks for 13 tests")
        .when(m == 4, "Whoever tests reports to Dr. Menon")
        .when(m == 5, 'The rule says "valve is  Tested" and "shall be tested yearly"')
        .otherwise("Nothing more is said. Tested valves stay")
    )
    sources = F.when(m == 0, F.array().cast("array<string>")).when(m == 1, F.array(F.lit("P9"))).when(m == 2, F.array(F.lit("P1"), F.lit("P9"))).otherwise(F.array(F.lit("P1"), F.lit("P2")))
    passage = lambda label, text: F.struct(F.lit(label).alias("label"), F.lit(text).alias("text"))
    passages = docs.select("answer_id", F.inline(F.array(passage("P1", "STD-12 Cl.4: the  valve is tested every 1500 hours"), passage("P2", "the note of the works"))))
    known = F.array(F.lit("nothing"), F.lit("the"))
    sentences = docs.select("answer_id", F.lit(1).alias("nth"), text.alias("text"), sources.alias("sources"))
    return checks.answer_problems(sentences, passages, known, retrieval.identifiers, retrieval.bare_id)


@query("""WITH p AS (SELECT o_custkey AS plan_id, min(o_orderkey) AS k FROM orders GROUP BY 1)
    SELECT plan_id, 'no part: write' AS problem FROM p WHERE plan_id % 4 IN (1, 2) UNION ALL SELECT plan_id, 'no part: inspect' FROM p WHERE plan_id % 4 = 2 UNION ALL SELECT plan_id, 'no parts' FROM p WHERE plan_id % 4 = 2
    UNION ALL SELECT plan_id, 'not listed: R-9' FROM p WHERE plan_id % 5 = 0 UNION ALL SELECT plan_id, 'not named: R-2' FROM p WHERE plan_id % 5 = 1""")
def plan_coverage(spark: Spark, d: str) -> DataFrame:
    """Steps that no part of a request asks for, and documents that aren't listed or that the request doesn't name."""
    plans, i = table(spark, d, "orders").select(F.col("o_custkey").alias("plan_id")).distinct(), F.col("plan_id")
    doc = F.when(i % 5 == 0, "R-9").when(i % 5 == 1, "R-2").otherwise("R-1")
    step = lambda n, kind, arg: F.struct(F.lit(n).alias("nth"), F.lit(kind).alias("kind"), arg.alias("arg"))
    steps = plans.select("plan_id", F.inline(F.array(step(1, "inspect", doc), step(2, "write", F.lit(None).cast("string")))))
    parts = plans.filter(i % 4 != 2).select("plan_id", F.explode(F.when(i % 4 == 1, F.array(F.lit("inspect"))).otherwise(F.array(F.lit("inspect"), F.lit("write"), F.lit("none")))).alias("kind"))
    kinds = spark.createDataFrame([("inspect", True, True), ("write", False, False)], "kind string, needs_arg boolean, takes_doc boolean")
    documents = spark.createDataFrame([("R-1", "TK-101"), ("R-2", "TK-102")], "doc string, name string")
    requests = plans.select("plan_id", F.lit("Please read the report on tk-101, not TK-102A").alias("text"))
    return checks.plan_problems(steps, kinds, 15, parts, documents, requests)


#: The twin's ranges, from the same registries, as numbers between which an address is local.
LOCAL = "(n BETWEEN 0 AND 16777215 OR n BETWEEN 167772160 AND 184549375 OR n BETWEEN 2851995648 AND 2852061183 OR n BETWEEN 2886729728 AND 2887778303 OR (n BETWEEN 3221225472 AND 3221225727 AND n NOT IN (3221225481, 3221225482)) OR n BETWEEN 3221225984 AND 3221226239 OR n BETWEEN 3232235520 AND 3232301055 OR n BETWEEN 3323068416 AND 3323199487 OR n BETWEEN 3325256704 AND 3325256959 OR n BETWEEN 3405803776 AND 3405804031 OR n >= 4026531840)"
STATES = "ESTABLISHED TIME_WAIT LISTENING SYN_SENT".split()
FIRSTS = [0, 10, 127, 169, 172, 192, 198, 203, 8, 224, 240, 255]


@query(f"""WITH a AS (SELECT event_id, event_id % 5 AS m, event_id % 4 AS st, [{", ".join(map(str, FIRSTS))}][CAST(event_id % {len(FIRSTS)} + 1 AS INTEGER)] AS a, CASE WHEN event_id % 3 = 0 THEN [0, 2, 16, 18, 51, 100, 168, 254, 31, 19][CAST(event_id // 12 % 10 + 1 AS INTEGER)] ELSE event_id * 37 % 256 END AS b, event_id // 7 % 256 AS c, event_id // 11 % 256 AS e FROM events),
    n AS (SELECT *, a::BIGINT * 16777216 + b * 65536 + c * 256 + e AS n, a || '.' || b || '.' || c || '.' || e AS v4 FROM a),
    r AS (SELECT event_id, ['ESTABLISHED', 'TIME_WAIT', 'LISTENING', 'SYN_SENT'][CAST(st + 1 AS INTEGER)] AS state, event_id + 4 AS pid, CASE m WHEN 0 THEN 'fe80::' || to_hex(c + 1) WHEN 1 THEN '2a01:' || to_hex(b + 1) || '::' || to_hex(c + 1) ELSE v4 END AS remote,
        CASE m WHEN 0 THEN 'local' WHEN 1 THEN 'external' ELSE CASE WHEN n = 0 THEN NULL WHEN n BETWEEN 2130706432 AND 2147483647 THEN 'loopback' WHEN {LOCAL} THEN 'local' ELSE 'external' END END AS scope FROM n)
    SELECT event_id, lower(remote) AS remote, state, pid, scope FROM r WHERE state <> 'LISTENING' AND scope IS NOT NULL""")
def connections(spark: Spark, d: str) -> DataFrame:
    """Listings of connections as rows, of all states but listening, with the scope of the other end; without unspecified ends and lines that are none."""
    i = F.col("event_id")
    some = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    a, c, e = some(FIRSTS, i % len(FIRSTS)), F.floor(i / 7) % 256, F.floor(i / 11) % 256
    b = F.when(i % 3 == 0, some([0, 2, 16, 18, 51, 100, 168, 254, 31, 19], F.floor(i / 12) % 10)).otherwise(i * 37 % 256)
    v6 = F.when(i % 5 == 0, F.concat(F.lit("fe80::"), F.hex(c + 1), F.lit("%eth"), i % 3)).when(i % 5 == 1, F.concat(F.lit("2a01:"), F.hex(b + 1), F.lit("::"), F.hex(c + 1)))
    remote = F.coalesce(F.concat(F.lit("["), v6, F.lit("]")), F.concat_ws(".", a, b, c, e))
    head = "Active Connections\r\n\r\n  Proto  Local Address  Foreign Address  State  PID\r\n  TCP    0.0.0.0:135   0.0.0.0:0   LISTENING   9\r\n  UDP    0.0.0.0:53   *:*   3\r\n  TCP  [::]:80  [::]:0  CLOSE_WAIT  5\r\n  TCP  1.2.3.4:9  printer:0  ESTABLISHED  5\r\n"
    line = F.concat(F.lit("  TCP    127.0.0.1:"), i % 60000, F.lit("   "), remote, F.lit(":443   "), some(STATES, i % 4), F.lit("   "), i + 4, F.lit("\r\n"))
    rows = table(spark, d, "events").select("event_id", F.inline(checks.netstat(F.concat(F.lit(head), line))))
    return rows.select("event_id", F.lower("remote").alias("remote"), "state", "pid", checks.scope(F.col("remote")).alias("scope")).filter("scope is not null")


@query("""SELECT o_orderkey AS key, 'enter your name' AS problem FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'action must be confirm or remeasure' FROM orders WHERE o_orderkey % 5 IN (0, 1)""")
def review_decisions(spark: Spark, d: str) -> DataFrame:
    i = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(i.alias("key"), F.when(i % 6 == 0, " ").when(i % 3 != 0, "R. Menon").alias("reviewer"), F.when(i % 5 == 1, "approve").when(i % 5 == 2, "remeasure").when(i % 5 > 2, "confirm").alias("action"))
    return rules.decision_problems(rows)


@query(f"""WITH {PRICED}, e AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN ' 7.25 ' END AS value FROM pr)
    SELECT doc_id, 'C-1.current_mm' AS field, '7.25' AS entered, cur AS read_as, 'qa' AS reviewer, 'ocr; current_mm entered by qa from the original report' AS method FROM e WHERE value IS NOT NULL""")
def review_audit(spark: Spark, d: str) -> DataFrame:
    """The log of entered values, beside the method that their rows now state."""
    rows = orders(spark, d).select("doc_id", F.lit("C-1").alias("cml_id"), F.col("cur").alias("current_mm"), F.lit("needs review").alias("review_status"), F.lit("ocr").alias("method"))
    entries = rows.filter("doc_id % 4 = 0").select("doc_id", "cml_id", F.lit(" 7.25 ").alias("value"))
    done = rules.apply_review(rows, entries, "qa").filter("review_status = 'entered by qa'").select("doc_id", "method")
    return rules.review_log(rows, entries, "qa").join(done, "doc_id")


# Answers over the documents themselves: a reply gives the first two lines of its document and perhaps a name or number of the next one, and cites its own, the next or nothing.
REPLIES = rf"""d AS (SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[^A-Za-z. \n]', '', 'g'), '\s+', ' ', 'g')) AS t FROM documents),
    w AS (SELECT d.doc_id, d.t, coalesce(n.t, '') AS other FROM d LEFT JOIN d n ON n.doc_id = d.doc_id + 1),
    p AS (SELECT doc_id, t AS one, 'Note ' || doc_id || ' of ' || (doc_id % 40) || ' pages' AS two FROM w),
    s AS (SELECT doc_id, 'stays as ' || coalesce(upper(substr(x, 1, 1)) || lower(substr(x, 2)), 'it') || ' has ' || CASE WHEN doc_id % 3 = 0 THEN doc_id % 40 ELSE 4242 END AS line, x FROM (SELECT doc_id, regexp_extract_all(CASE WHEN doc_id % 2 = 0 THEN t ELSE other END, '[A-Za-z]+')[1] AS x FROM w)),
    o AS (SELECT s.doc_id, x, contains(lower(one || ' ' || two), lower(x)) OR contains('a passage is cited by its label.', lower(x)) AS there, doc_id % 40 AS pages FROM s JOIN p USING (doc_id))"""


@query(f"""WITH {REPLIES} SELECT doc_id AS answer_id, 1 AS nth, 'names: ' || upper(substr(x, 1, 1)) || lower(substr(x, 2)) AS problem FROM o WHERE doc_id % 4 < 2 AND length(x) > 1 AND NOT there
    UNION ALL SELECT doc_id, 1, 'number: 4242' FROM o WHERE doc_id % 4 < 2 AND doc_id % 3 <> 0
    UNION ALL SELECT doc_id, NULL, 'gives no sentences' FROM o WHERE doc_id % 4 = 2 UNION ALL SELECT doc_id, NULL, 'cannot answer, but gives sentences' FROM o WHERE doc_id % 4 = 3
    UNION ALL SELECT doc_id, NULL, 'note number: 77' FROM o WHERE doc_id % 5 = 0 AND doc_id % 40 <> 77 AND doc_id <> 77
    UNION ALL SELECT doc_id, NULL, 'note names: Oslo' FROM o JOIN p USING (doc_id) WHERE doc_id % 5 = 1 AND NOT contains(lower(one), 'oslo')""")
def reply_grounding(spark: Spark, d: str) -> DataFrame:
    """Whole replies about documents against their own words: names and numbers of sentences and of notes, the answerable flag."""
    i = F.col("doc_id")
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^A-Za-z. \n]", ""), r"\s+", " "))
    path = place(spark)
    head = F.regexp_extract("t", "[A-Za-z]+", 0)
    table(spark, d, "documents").select("doc_id", plain.alias("t")).withColumn("head", F.when(head != "", head)).write.parquet(path)
    rows = spark.read.parquet(path)  # plain texts, made once; of the next document only the first word is wanted
    rows = rows.join(rows.select((i - 1).alias("doc_id"), F.col("head").alias("next")), "doc_id", "left")
    first = F.when(i % 2 == 0, F.col("head")).otherwise(F.col("next"))
    name = F.coalesce(F.concat(F.upper(F.substring(first, 1, 1)), F.lower(F.substr(first, F.lit(2)))), F.lit("it"))
    line = F.concat(F.lit("stays as "), name, F.lit(" has "), F.when(i % 3 == 0, i % 40).otherwise(4242))
    key = i.alias("answer_id")
    sentences = rows.filter(i % 4 != 2).select(key, F.lit(1).alias("nth"), line.alias("text"), F.array(F.lit("P1"), F.lit("P2")).alias("sources"))
    passage = lambda label, text: F.struct(F.lit(label).alias("label"), text.alias("text"))
    passages = rows.select(key, F.inline(F.array(passage("P1", F.col("t")), passage("P2", F.concat(F.lit("Note "), i, F.lit(" of "), i % 40, F.lit(" pages"))))))
    note = F.when(i % 5 == 0, "Nothing in P1 says 77 of it").when(i % 5 == 1, "Nobody there names Oslo").otherwise("Passage P2 of the note lacks it")
    replies = rows.select(key, F.lit("what is said of it").alias("question"), (i % 4 != 3).alias("answerable"), note.alias("missing"))
    return checks.reply_grounding(replies, sentences, passages, F.array(F.lit("nothing")), retrieval.identifiers, retrieval.bare_id, "A passage is cited by its label.")


# Orders' lines as steps: each customer's plan has its orders' priorities as kinds, and asks about reports, tasks and questions that come from the same rows.
PLANS = """st AS (SELECT o_custkey AS plan_id, o_orderkey AS nth, CASE o_orderpriority WHEN '1-URGENT' THEN 'inspect' WHEN '2-HIGH' THEN 'search' WHEN '3-MEDIUM' THEN 'code' WHEN '5-LOW' THEN 'write' ELSE 'unknown' END AS kind,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'R-' || (o_orderkey % 40) WHEN '2-HIGH' THEN 'what of ' || CASE WHEN o_orderkey % 3 = 0 THEN 'tk-' || (o_orderkey % 50) || 'X' ELSE 'Tk-' || (o_orderkey % 50) END || ' is said' WHEN '3-MEDIUM' THEN 'T' || (o_orderkey % 6) ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'ignored' END END AS arg FROM orders),
    pl AS (SELECT c_custkey AS plan_id, CASE WHEN c_custkey % 3 = 0 THEN 'no pump is listed' ELSE ' ' END AS np, CASE WHEN c_custkey % 4 = 0 THEN 'Read the Report on tk-' || (c_custkey % 40) || ' and TK-7, please' ELSE 'Look at TK-7, TK-1, TK-9' END AS req FROM customer),
    pt AS (SELECT c_custkey AS plan_id, unnest(['inspect', 'none', 'write']) AS kind, unnest(['the  reading', 'a pump', 'the note']) AS text, unnest([c_custkey % 2 = 0, c_custkey % 5 = 0, c_custkey % 7 > 1]) AS has FROM customer), pa AS (SELECT * FROM pt WHERE has),
    good AS (SELECT DISTINCT plan_id, kind FROM st WHERE kind <> 'unknown'), undone AS (SELECT plan_id, regexp_replace(text, ' +', ' ', 'g') AS text FROM pa WHERE (plan_id, kind) NOT IN (SELECT plan_id, kind FROM good))"""


@query(f"""WITH {PLANS} SELECT DISTINCT plan_id, 'unknown kind: unknown' AS problem FROM st WHERE kind = 'unknown'
    UNION SELECT plan_id, 'repeated: ' || kind FROM st WHERE kind <> 'unknown' GROUP BY plan_id, kind, CASE WHEN kind = 'write' THEN '' ELSE arg END HAVING count(*) > 1
    UNION SELECT plan_id, 'too many steps' FROM st GROUP BY plan_id HAVING count(*) > 12
    UNION SELECT plan_id, 'no part: ' || kind FROM good WHERE (plan_id, kind) NOT IN (SELECT plan_id, kind FROM pa)
    UNION SELECT plan_id, 'no parts' FROM pl WHERE plan_id NOT IN (SELECT plan_id FROM pa)
    UNION SELECT plan_id, 'not listed: ' || arg FROM st WHERE kind = 'inspect' AND CAST(substr(arg, 3) AS INTEGER) >= 30
    UNION SELECT plan_id, 'not named: ' || arg FROM st JOIN pl USING (plan_id) WHERE kind = 'inspect' AND CAST(substr(arg, 3) AS INTEGER) < 30 AND NOT list_contains(list_transform(regexp_extract_all(upper(req), 'TK-[0-9]+'), lambda x: substr(x, 4)), substr(arg, 3))
    UNION SELECT plan_id, 'search asks about: ' || string_agg(DISTINCT 'TK-' || (nth % 50), ', ' ORDER BY 'TK-' || (nth % 50)) FROM st WHERE kind = 'search' AND nth % 3 <> 0 AND nth % 50 < 30 GROUP BY plan_id
    UNION SELECT plan_id, 'no such task: ' || arg FROM st WHERE kind = 'code' AND arg NOT IN ('T1', 'T2', 'T3')
    UNION SELECT plan_id, 'no steps, and no reason' FROM pl WHERE trim(np) = '' AND plan_id NOT IN (SELECT plan_id FROM good)
    UNION SELECT plan_id, 'undone: ' || text FROM undone JOIN pl USING (plan_id) WHERE trim(np) = ''
    UNION SELECT plan_id, 'said to be impossible, but every part has a step' FROM pl WHERE trim(np) <> '' AND plan_id IN (SELECT plan_id FROM pa) AND plan_id NOT IN (SELECT plan_id FROM undone)
    UNION SELECT plan_id, 'needs a regulated step' FROM pl WHERE plan_id % 4 = 0 AND plan_id IN (SELECT plan_id FROM good) AND plan_id NOT IN (SELECT plan_id FROM good WHERE kind = 'inspect')""")
def plan_whole(spark: Spark, d: str) -> DataFrame:
    """Plans against parts, documents, tasks, what is said to be impossible and what is regulated, from customers and their orders."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    kind = F.coalesce(*[F.when(F.col("o_orderpriority") == p, name) for p, name in (("1-URGENT", "inspect"), ("2-HIGH", "search"), ("3-MEDIUM", "code"), ("5-LOW", "write"))], F.lit("unknown"))
    about = F.concat(F.lit("what of "), F.when(k % 3 == 0, F.concat(F.lit("tk-"), k % 50, F.lit("X"))).otherwise(F.concat(F.lit("Tk-"), k % 50)), F.lit(" is said"))
    arg = F.when(kind == "inspect", F.concat(F.lit("R-"), k % 40)).when(kind == "search", about).when(kind == "code", F.concat(F.lit("T"), k % 6)).when(k % 2 == 0, "ignored")
    steps = o.select(F.col("o_custkey").alias("plan_id"), k.alias("nth"), kind.alias("kind"), arg.alias("arg"))
    c = F.col("plan_id")
    plans = table(spark, d, "customer").select(F.col("c_custkey").alias("plan_id")).withColumn("not_possible", F.when(c % 3 == 0, "no pump is listed").otherwise(" "))
    text = F.when(c % 4 == 0, F.concat(F.lit("Read the Report on tk-"), c % 40, F.lit(" and TK-7, please"))).otherwise("Look at TK-7, TK-1, TK-9")
    part = lambda kind, text, has: F.when(has, F.struct(F.lit(kind).alias("kind"), F.lit(text).alias("text")))
    parts = plans.select("plan_id", F.inline(F.array_compact(F.array(part("inspect", "the  reading", c % 2 == 0), part("none", "a pump", c % 5 == 0), part("write", "the note", c % 7 > 1)))))
    kinds = spark.createDataFrame([("inspect", True, True, False, False, True), ("search", True, False, False, True, False), ("code", True, False, True, False, False), ("write", False, False, False, False, False)], "kind string, needs_arg boolean, takes_doc boolean, takes_task boolean, no_documents boolean, regulated boolean")
    documents = spark.range(30).select(F.concat(F.lit("R-"), "id").alias("doc"), F.concat(F.lit("TK-"), "id").alias("name"))
    tasks = spark.createDataFrame([("T1",), ("T2",), ("T3",)], "task string")
    library = spark.createDataFrame([("SOP-1",)], "doc string")
    return checks.plan_problems(steps, kinds, 12, parts, documents, plans.select("plan_id", text.alias("text")), tasks, plans, library, [r"\bread the report\b"])
