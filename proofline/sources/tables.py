"""Evidence views over star-schema tables, and readers of the engine's own sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(column: str):
    """A double as exact text with two places."""
    return F.col(column).cast("decimal(18,2)").cast("string")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as readings: extended price against quantity times retail price; returned ones are held."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    rows = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    least = (F.col("l_quantity").cast("decimal(18,2)") * F.col("p_retailprice").cast("decimal(18,2)")).cast("decimal(18,2)")
    status = F.when(F.col("l_returnflag") == "R", "needs review").when(F.col("l_returnflag") == "A", "entered by qa").otherwise("accepted")
    return rows.select(
        F.col("l_orderkey").alias("doc_id"),
        F.concat_ws("-", F.lit("CML"), "l_linenumber", "l_partkey", "l_suppkey").alias("cml_id"),
        F.concat(F.lit("S-"), F.col("l_suppkey") % 10).alias("equipment_tag"),
        money("l_extendedprice").alias("current_mm"),
        least.cast("string").alias("min_required_mm"),
        status.alias("review_status"),
        F.col("l_partkey").alias("item"),
        F.col("l_shipdate").alias("moment"),
    )


#: The same view for the SQL twins.
READINGS = """readings AS (SELECT l_orderkey AS doc_id, 'CML-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS cml_id,
    'S-' || (l_suppkey % 10) AS equipment_tag, CAST(l_extendedprice AS DECIMAL(18,2)) AS cur,
    CAST(CAST(l_quantity AS DECIMAL(18,2)) * CAST(p_retailprice AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS least,
    CASE l_returnflag WHEN 'R' THEN 'needs review' WHEN 'A' THEN 'entered by qa' ELSE 'accepted' END AS review_status,
    l_partkey AS item, l_shipdate AS moment FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as findings of customers' reports: the priority is the grade, of which one can't be read."""
    grade = {"1-URGENT": "Critical", "2-HIGH": "Major", "3-MEDIUM": "Minor", "5-LOW": "Observation"}
    severity = F.coalesce(*[F.when(F.col("o_orderpriority") == k, v) for k, v in grade.items()], F.col("o_orderpriority"))
    rows = table(spark, sf_dir, "orders")
    return rows.select(
        F.col("o_custkey").alias("doc_id"),
        F.concat(F.lit("F-"), "o_orderkey").alias("finding_id"),
        severity.alias("severity"),
        F.concat(F.lit("Tag-"), F.col("o_custkey") % 7).alias("equipment_tag"),
        F.concat(F.lit("STD-"), F.col("o_orderkey") % 120, F.lit(" Cl. "), F.col("o_orderkey") % 9, F.lit(".2")).alias("ref_clause"),
    )


FINDINGS = """findings AS (SELECT o_custkey AS doc_id, 'F-' || o_orderkey AS finding_id,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'Major' WHEN '3-MEDIUM' THEN 'Minor' WHEN '5-LOW' THEN 'Observation' ELSE o_orderpriority END AS severity,
    'Tag-' || (o_custkey % 7) AS equipment_tag, 'STD-' || (o_orderkey % 120) || ' Cl. ' || (o_orderkey % 9) || '.2' AS ref_clause FROM orders)"""


def report_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as findings of their own reports, to go with ``readings``."""
    return findings(spark, sf_dir).withColumn("doc_id", F.expr("cast(substring(finding_id, 3) as long)"))


REPORT_FINDINGS = FINDINGS + ", report_findings AS (SELECT CAST(substr(finding_id, 3) AS BIGINT) AS doc_id, finding_id, severity FROM findings)"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as positioned text: pages are orders, a row for each line number, a little tilted."""
    rows = table(spark, sf_dir, "lineitem")
    y0 = F.col("l_linenumber") * 30.0 + F.col("l_suppkey") % 7 + (F.col("l_partkey") % 500) * 0.01
    x0 = (F.col("l_partkey") % 500) * 1.0
    box = {"x0": x0, "y0": y0, "x1": x0 + 40.0 + F.col("l_suppkey") % 13, "y1": y0 + 10.0 + F.col("l_suppkey") % 5}
    return rows.select(
        F.col("l_orderkey").alias("page"),
        F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", money("l_extendedprice")).alias("id"),
        F.concat("l_returnflag", "l_linestatus", F.col("l_partkey") % 4).alias("text"),
        *[v.cast("double").alias(k) for k, v in box.items()],
        (F.lit(1.0) - F.col("l_discount") * 1.5).alias("score"),
    )


ITEMS = """items AS (SELECT l_orderkey AS page, l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(l_extendedprice AS DECIMAL(18,2)) AS id,
    l_returnflag || l_linestatus || (l_partkey % 4) AS text, CAST(l_partkey % 500 AS DOUBLE) AS x0,
    l_linenumber * 30.0::DOUBLE + l_suppkey % 7 + (l_partkey % 500) * 0.01::DOUBLE AS y0,
    (l_partkey % 500) * 1.0::DOUBLE + 40.0::DOUBLE + l_suppkey % 13 AS x1,
    l_linenumber * 30.0::DOUBLE + l_suppkey % 7 + (l_partkey % 500) * 0.01::DOUBLE + 10.0::DOUBLE + l_suppkey % 5 AS y1,
    1.0::DOUBLE - l_discount * 1.5::DOUBLE AS score FROM lineitem)"""


def audit_log(spark: SparkSession, path: str) -> DataFrame:
    """file, nth, line, prev_sha256 of JSON Lines logs: a line's number from 0 is its place in its file, however many tasks read the file.

    First each task counts the lines of each split; running sums over a file's splits then number the lines. Lines keep the
    order that they have in a split, and splits are cut alike in both passes. A last line without a line break counts; an empty one after the last break doesn't.
    """
    m = F.col("_metadata")
    rows = spark.read.text(path).select(m["file_path"].alias("file"), m["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    blocks = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("file", "block", "first", before.alias("before"))
    numbered = rows.join(blocks, ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("first")).alias("nth"), "line")
    return numbered.withColumn("prev_sha256", F.get_json_object("line", "$.prev_sha256"))


def ground_truth(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Reports from JSON, a document or an array of documents for each file; numbers stay text so that nothing is rounded.

    With ``schema`` (all values string) the files are read once, not twice.
    """
    reader = spark.read.option("multiLine", True).option("primitivesAsString", True)
    return (reader.schema(schema) if schema else reader).json(path)


def truth_rows(reports: DataFrame, index: DataFrame, part: str) -> DataFrame:
    """A row for each entry of the array ``part`` of reports that the index (doc_id, ...) holds, with the index's columns.

    Reports without that array, or with an empty one, give no rows.
    """
    rows = reports.select("doc_id", F.explode(part).alias("entry")).select("doc_id", "entry.*")
    return rows.join(index, "doc_id")


def catalogue(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """name, path of wanted files and folders of files, at any depth; path is null for those that are missing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
    # a table in parts is a folder, and counts once: of each file all folders between it and the root
    steps = F.split(F.substr("path", F.lit(len(root) + 2)), "/")
    ways = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.concat_ws("/", F.lit(root), F.array_join(F.slice(steps, 1, n), "/")))
    there = files.select(F.explode(ways).alias("path")).distinct()
    there = there.withColumn("name", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1))
    return wanted.join(there, "name", "left").select("name", "path")


def ordered_pages(paths: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages of documents in the order given, not listed. paths: doc_id, paths (array); pages: path, ..."""
    return paths.select("doc_id", F.posexplode("paths").alias("nth", "path")).join(pages, "path")
