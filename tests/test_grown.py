"""Queries against their SQL twins on tables that sf0.001 doesn't resemble: large ids, long texts, tables in parts."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (registers all queries)
from proofline.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def rows(found):
    return sorted(found, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.fixture
def grown(spark, tmp_path):
    """Writes tables and compares a query's rows on them with its SQL's."""

    def compare(name, **tables):
        con = duckdb.connect()
        for table, df in tables.items():
            df.write.parquet(f"file://{tmp_path}/{table}.parquet")
            con.sql(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
        df = QUERIES[name](spark, str(tmp_path))
        want = con.sql(f"select {', '.join(df.columns)} from ({ORACLES[name]}) x").fetchall()
        assert rows(map(tuple, df.collect())) == rows(want)

    return compare


def documents(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string")


def test_catalogue_of_tables_in_parts(spark, grown):
    parts = spark.range(20).repartition(3)
    grown("catalogue_missing", orders=parts, lineitem=parts, pages=parts)


def test_pointers_where_every_id_of_five_digits_is_there(spark, grown):
    grown("cross_references", documents=documents(spark, [(i, "x") for i in (0, 7, 14, 99_998, 99_999, 100_000)]))


def test_sections_of_long_texts(spark, grown):
    grown("section_ordinal", documents=documents(spark, [(1, "\n".join(["a line"] * 1300)), (2, "a\nb")]))


def test_reports_share_files(spark, tmp_path, monkeypatch):
    from proofline.plans import storage

    monkeypatch.setattr(storage, "place", lambda spark: f"file://{tmp_path}/reports")
    supplier = spark.range(2500).select(F.col("id").alias("s_suppkey"), (F.col("id") % 25).alias("s_nationkey"), (F.col("id") * 1.5).alias("s_acctbal"))
    supplier.write.parquet(f"file://{tmp_path}/supplier.parquet")
    df = QUERIES["ground_truth_rows"](spark, str(tmp_path))
    want = duckdb.sql(f"with supplier as (from '{tmp_path}/supplier.parquet/*.parquet') select {', '.join(df.columns)} from ({ORACLES['ground_truth_rows']}) x").fetchall()
    assert rows(map(tuple, df.collect())) == rows(want)
    assert len(list((tmp_path / "reports").glob("part-*"))) <= 4


def test_tasks_grow_with_the_table(spark):
    from proofline.functions import sizes
    from proofline.llm import jaccard

    df = spark.range(10).withColumnRenamed("id", "doc_id")
    assert sizes.spread(df, 10, "doc_id").rdd.getNumPartitions() == 4
    assert sizes.spread(df, 25 * sizes.ROWS + 1, "doc_id").rdd.getNumPartitions() == 26
    totals = spark.createDataFrame([(1,), (200_000,), (4_000_000,), (30_000_000,)], "total long")
    assert [r[0] for r in totals.select(jaccard.blocks_of(F.col("total"))).collect()] == [1, 1, 4, 15]  # a set is sent once for each block


def test_plain_texts_of_replies_are_made_once(spark):
    """The table is read for them alone; everything else goes on from what was written."""
    df = QUERIES["reply_grounding"](spark, DATA)
    assert df.inputFiles() and not any("documents" in f for f in df.inputFiles())


def test_postings_are_dealt_by_term_once(spark, tmp_path):
    from proofline.operators import index

    docs, sc = spark.createDataFrame([(i, f"all w{i % 7} w{i}") for i in range(300)], "doc_id long, text string"), spark.sparkContext
    sc.setJobGroup("index of words", "")
    try:
        index.write(docs, f"file://{tmp_path}/index")
        tracker = sc.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("index of words") for s in tracker.getJobInfo(j).stageIds}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(stages) <= 18  # 16; a second shuffle of the postings and its sampling come to 22
    assert spark.read.parquet(f"file://{tmp_path}/index/postings").selectExpr("sum(size(postings))").first()[0] == 300 + 300 + 293


def test_readings_of_notes_are_stored_without_what_follows_from_them(spark, tmp_path, monkeypatch):
    from proofline.plans import integrity

    monkeypatch.setattr(integrity, "place", lambda _: f"file://{tmp_path}/notes")
    integrity.note_readback(spark, DATA)
    assert spark.read.parquet(f"file://{tmp_path}/notes/readings").columns == ["doc_id", "cml_id", "current", "minimum"]
