"""Queries that write and read back: rebuilds, stage files, registries, chained logs, ground truth, catalogues."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.functions.sizes import NARROW, spread
from proofline.operators import audit, shelf
from proofline.plans.registry import query
from proofline.sources import registry, sinks
from proofline.sources import tables as T
from proofline.sources.tables import money, table

Spark = SparkSession


def place(spark: Spark) -> str:
    """A new path below the folder for checkpoints, which every executor can reach. Where that is unset, a temporary one in local mode; a cluster needs the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='proofline-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/io/{uuid.uuid4().hex}"


@query("SELECT o_orderkey AS doc_id, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS value FROM orders WHERE o_orderstatus = 'F'")
def full_rebuild(spark: Spark, d: str) -> DataFrame:
    """An index that is built, built anew from fewer rows, and read back: nothing of the first is left."""
    rows, path = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), money("o_totalprice").alias("value"), "o_orderstatus"), place(spark)
    sinks.rebuild(rows.drop("o_orderstatus"), path)
    sinks.rebuild(rows.filter("o_orderstatus = 'F'").drop("o_orderstatus"), path)
    return spark.read.parquet(path)


@query("SELECT o_custkey AS doc_id, count(*) AS n, count(CASE WHEN o_orderkey % 5 <> 0 THEN 1 END) AS filled, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS VARCHAR) AS total FROM orders GROUP BY 1")
def stage_file(spark: Spark, d: str) -> DataFrame:
    """A stage's rows as JSON Lines and back: nulls are written out, numbers stay as printed."""
    rows, path = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("p"), money("o_totalprice").alias("value")), place(spark)
    sinks.stage_json(rows, path)
    lines = spark.read.text(path)
    found = lines.select(F.from_json("value", "doc_id long, p string, value string").alias("r"), F.contains(F.col("value"), F.lit('"p":')).alias("has")).filter("has").select("r.*")
    total = F.sum(F.col("value").cast("decimal(18,2)")).cast("string")
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.count("p").alias("filled"), total.alias("total"))


@query("""WITH o AS (SELECT o_orderkey AS doc_id, o_orderpriority AS model, o_orderstatus, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS share, CAST(o_orderkey % 2 = 0 AS DOUBLE) AS parity, CAST(o_custkey % 7 AS DOUBLE) AS wrong FROM orders)
    SELECT doc_id, 'gate' AS source, 'read' AS task, 'parity' AS key, 'bool' AS kind, 0 AS ord, parity AS value FROM o UNION ALL SELECT doc_id, 'gate', 'read', 'share', 'float', 1, share FROM o UNION ALL SELECT doc_id, 'gate', 'read', 'wrong_outputs', 'int', 2, wrong FROM o
    UNION ALL SELECT doc_id, 'gate', 'write', 'wrong_outputs', 'int', 0, 1.0 FROM o WHERE o_orderstatus = 'F'
    UNION ALL SELECT doc_id, model, 'read', 'share', NULL, NULL, share FROM o UNION ALL SELECT doc_id, model, 'read', 'parity', NULL, NULL, parity FROM o UNION ALL SELECT doc_id, 'b', 'write', 'wrong_outputs', NULL, NULL, wrong FROM o""")
def registry_tables(spark: Spark, d: str) -> DataFrame:
    """Every order as a registry in JSON: its gates, in the order written, and its candidates' results."""
    write = F.when(F.col("o_orderstatus") == "F", ', "write": {"gate": {"wrong_outputs": 1}}').otherwise("")
    parity = F.when(F.col("o_orderkey") % 2 == 0, "true").otherwise("false")
    share, wrong = money("o_totalprice"), F.col("o_custkey") % 7
    text = F.concat(
        F.lit('{"tasks": {"read": {"gate": {"parity": '), parity, F.lit(', "share": '), share, F.lit(', "wrong_outputs": '), wrong, F.lit("}}"), write, F.lit('}, "models": {"'),
        "o_orderpriority", F.lit('": {"results": {"read": {"share": '), share, F.lit(', "parity": '), parity, F.lit(', "evidence": ["x"]}}}, "b": {"results": {"write": {"wrong_outputs": '), wrong, F.lit('}}}, "c": {}}}'),
    )
    gates, results = registry.tables_of(table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("text")), "doc_id")
    a = gates.select("doc_id", F.lit("gate").alias("source"), "task", "key", "kind", "ord", F.col("want").alias("value"))
    none = F.lit(None)
    return a.unionByName(results.select("doc_id", F.col("model").alias("source"), "task", "key", none.cast("string").alias("kind"), none.cast("int").alias("ord"), F.col("have").alias("value")))


def chained_nations(spark: Spark, d: str) -> DataFrame:
    """A log to which all nations are appended, those of the first ten keys in a batch of their own."""
    rows, path = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit('{"k": '), "n_nationkey", F.lit("}")).alias("payload")), place(spark)
    for batch in (rows.filter("n_nationkey < 10"), rows.filter("n_nationkey >= 10")):
        sinks.append_chained(batch, path, "n_nationkey")
    return spark.read.parquet(path)


LINKS = """o AS (SELECT n_nationkey AS k, row_number() OVER (ORDER BY n_nationkey) - 1 AS nth FROM nation),
    c AS (SELECT nth, '{"k": ' || k || ', "prev_sha256": "' || repeat('0', 64) || '"}' AS line, repeat('0', 64) AS prev_sha256 FROM o WHERE nth = 0
        UNION ALL SELECT o.nth, '{"k": ' || o.k || ', "prev_sha256": "' || sha256(c.line) || '"}', sha256(c.line) FROM c JOIN o ON o.nth = c.nth + 1)"""


@query(f"WITH RECURSIVE {LINKS} SELECT nth, line, prev_sha256 FROM c")
def chained_append(spark: Spark, d: str) -> DataFrame:
    """The second batch goes on from the last line of the first."""
    return chained_nations(spark, d)


@query("""WITH o AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS nth FROM nation), k AS (SELECT nth, nth % 7 = 0 AS out FROM o)
    SELECT 'whole' AS log, count(*) AS n, CAST(NULL AS INTEGER) AS broken_at FROM k UNION ALL SELECT 'cut', count(*) FILTER (NOT out), CAST((SELECT min(a.nth) FROM k a JOIN k b ON b.nth = a.nth - 1 AND b.out WHERE NOT a.out) - 1 AS INTEGER) FROM k""")
def audit_files(spark: Spark, d: str) -> DataFrame:
    """A log's file as it is, and one from which every seventh line is gone, read back and verified."""
    lines, path = chained_nations(spark, d), place(spark)
    kinds = lines.withColumn("kind", F.explode(F.when((F.col("nth") + 1) % 7 == 0, F.array(F.lit("whole"))).otherwise(F.array(F.lit("whole"), F.lit("cut")))))
    kinds.repartition("kind").sortWithinPartitions("kind", "nth").select("kind", "line").write.partitionBy("kind").text(path)
    log = T.audit_log(spark, path).withColumn("log", F.regexp_extract("file", "kind=([a-z]+)", 1))
    return audit.breaks(log, "log", "nth").select("log", "n", "broken_at")


#: Reports in one file.
REPORTS = 1000


@query("""WITH i AS (SELECT s_suppkey AS doc_id, s_nationkey AS place FROM supplier WHERE s_suppkey % 6 <> 0),
    r AS (SELECT s_suppkey AS doc_id, unnest(['1', '2']) AS id, CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS VARCHAR) || '0' AS value FROM supplier WHERE s_suppkey % 5 <> 0)
    SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'reading' AS part, id, value, CAST(place AS VARCHAR) AS place FROM r JOIN i USING (doc_id)
    UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'finding', 'F-' || s_suppkey, 'Major', CAST(i.place AS VARCHAR) FROM supplier JOIN i ON i.doc_id = s_suppkey WHERE s_suppkey % 4 = 0""")
def ground_truth_rows(spark: Spark, d: str) -> DataFrame:
    """Suppliers as reports in JSON files, read back and taken apart; only those in the index count, and digits stay as printed."""
    s, path = table(spark, d, "supplier"), place(spark)
    key = F.col("s_suppkey")
    digits = F.concat(money("s_acctbal"), F.lit("0"))
    reading = lambda n: F.concat(F.lit(f'{{"id": "{n}", "value": '), digits, F.lit("}"))
    readings = F.when(key % 5 != 0, F.concat_ws(", ", reading(1), reading(2))).otherwise("")
    found = F.when(key % 4 == 0, F.concat(F.lit('{"id": "F-'), key, F.lit('", "value": "Major"}'))).otherwise("")
    report = F.concat(F.lit('{"doc_id": '), key, F.lit(',\n "readings": ['), readings, F.lit('],\n "findings": ['), found, F.lit("]}"))
    # an array of reports for each file: a file of its own for each report costs more than what is in it
    arrays = s.groupBy(F.floor(key / REPORTS)).agg(F.concat(F.lit("["), F.array_join(F.collect_list(report), ",\n"), F.lit("]")).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    entry = "array<struct<id: string, value: string>>"
    reports = T.ground_truth(spark, path, f"doc_id string, readings {entry}, findings {entry}")
    index = s.filter("s_suppkey % 6 <> 0").select(key.cast("string").alias("doc_id"), F.col("s_nationkey").cast("string").alias("place"))
    rows = lambda part: T.truth_rows(reports, index, f"{part}s").select("doc_id", F.lit(part).alias("part"), "id", "value", "place")
    return rows("reading").unionByName(rows("finding"))


@query("SELECT * FROM (VALUES ('orders', true), ('lineitem', true), ('pages', true), ('nowhere', false)) v(name, found)")
def catalogue_missing(spark: Spark, d: str) -> DataFrame:
    """Wanted files of the input folder, and which of them are there."""
    wanted = spark.createDataFrame([("orders",), ("lineitem",), ("pages",), ("nowhere",)], "name string")
    return T.catalogue(spark, d, wanted).select("name", F.col("path").isNotNull().alias("found"))


PARTS = """SELECT 'report' AS part, o_orderkey AS doc_id, CAST(CASE WHEN o_orderstatus = 'F' THEN o_custkey + 1 ELSE o_custkey END AS VARCHAR) AS value FROM orders
    UNION ALL SELECT 'reading', l_orderkey, CAST(count(*) AS VARCHAR) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F' OR l_linenumber % 2 = 0 GROUP BY l_orderkey
    UNION ALL SELECT 'finding', o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus <> 'F'"""


@query(PARTS)
def three_tables_at_once(spark: Spark, d: str) -> DataFrame:
    """Reports, readings and findings in one commit: all come, then those of finished orders come again with fewer readings and no findings; a write that fails halfway leaves no trace."""
    o, path = table(spark, d, "orders"), place(spark)
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    n = lines.count()  # from the file's footer
    lines = spread(lines, n, "l_orderkey", each=NARROW).join(spread(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), n, "l_orderkey", each=NARROW), "l_orderkey")
    reports = o.select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("place"), "o_orderstatus")
    readings = lines.select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", "o_orderstatus")
    findings = o.select(F.col("o_orderkey").alias("doc_id"), "o_orderpriority")
    shelf.ingest(spark, path, {"reports": reports, "readings": readings, "findings": findings}, rows=n)
    done = F.col("o_orderstatus") == "F"
    again = {"reports": reports.filter(done).withColumn("place", F.col("place") + 1), "readings": readings.filter(done & (F.col("l_linenumber") % 2 == 0)), "findings": findings.filter("false")}
    shelf.ingest(spark, path, again, rows=n)
    broken = readings.withColumn("l_linenumber", F.when(F.col("doc_id") > 0, F.raise_error(F.lit("the third write breaks off"))).otherwise(1).cast("int"))
    try:
        shelf.ingest(spark, path, {"reports": reports.filter(done), "readings": broken, "findings": findings}, rows=n)
    except Exception as error:  # noqa: BLE001
        if "breaks off" not in str(error):
            raise
    state = shelf.manifest(spark, path)[1]
    reports, readings, findings = (shelf.read(spark, path, name, state) for name in ("reports", "readings", "findings"))
    rows = lambda part, df, value: df.select(F.lit(part).alias("part"), "doc_id", value.cast("string").alias("value"))
    counted = spread(readings.select("doc_id"), n, "doc_id", each=NARROW).groupBy("doc_id").agg(F.count("*").alias("n"))
    return rows("report", reports, F.col("place")).unionByName(rows("reading", counted, F.col("n"))).unionByName(rows("finding", findings, F.col("o_orderpriority")))


@query("SELECT sha256(text) AS key, length(text) AS n, 'first' AS run FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL AND doc_id % 3 <> 0) UNION ALL SELECT sha256(text), length(text), 'second' FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)")
def content_cache(spark: Spark, d: str) -> DataFrame:
    """Results by content: a first run over some of the texts, then one over all, which computes only what is missing, then one that computes nothing."""
    docs, path = table(spark, d, "documents").filter("text is not null").select(F.sha2("text", 256).alias("key"), "text", "doc_id"), place(spark)
    compute = lambda rows: rows.select("key", F.length("text").alias("n"))
    nothing = lambda rows: rows.select("key", F.raise_error(F.lit("all is known")).cast("int").alias("n"))
    first = shelf.cached(docs.filter("doc_id % 3 <> 0"), path, "key", compute).withColumn("run", F.lit("first"))
    shelf.cached(docs, path, "key", compute)
    return first.unionByName(shelf.cached(docs, path, "key", nothing).withColumn("run", F.lit("second")))
