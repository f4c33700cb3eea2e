"""Writers: full rebuilds, JSON for each stage, and a log that is chained as it grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.operators.audit import GENESIS


def rebuild(df: DataFrame, path: str) -> None:
    """Replaces a whole index."""
    df.write.mode("overwrite").parquet(path)


def stage_json(df: DataFrame, path: str) -> None:
    """A stage's rows as JSON Lines, with nulls written out."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def last_link(spark: SparkSession, path: str) -> str:
    """The hash that the next line of a chained log must carry: of its last line, or the genesis."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return GENESIS
    last = spark.read.parquet(path).agg(F.max_by("line", "nth").alias("line")).first()
    return GENESIS if last is None or last["line"] is None else spark.range(1).select(F.sha2(F.lit(last["line"]), 256)).first()[0]


def append_chained(events: DataFrame, path: str, order: str) -> int:
    """Appends events (column ``payload``, JSON) to a chained log; returns how many. One writer at a time, as chains go.

    The link is in the line itself, so each line's text depends on the one before: a batch is
    chained in one pass over its sorted rows. For use in ``foreachBatch``.
    """
    import hashlib
    import json

    spark = events.sparkSession
    link, rows = last_link(spark, path), []
    done = spark.read.parquet(path).count() if link != GENESIS else 0
    for payload in (r[0] for r in events.orderBy(order).select("payload").toLocalIterator()):
        line = json.dumps({**json.loads(payload), "prev_sha256": link}, ensure_ascii=False)
        rows.append((done + len(rows), line, link))
        link = hashlib.sha256(line.encode()).hexdigest()
        if len(rows) == 10_000:
            spark.createDataFrame(rows, "nth long, line string, prev_sha256 string").coalesce(1).write.mode("append").parquet(path)
            done, rows = done + len(rows), []
    if rows:
        spark.createDataFrame(rows, "nth long, line string, prev_sha256 string").coalesce(1).write.mode("append").parquet(path)
    return done + len(rows)
