"""Integrity: hash-chained logs and fingerprints of evidence."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

GENESIS = "0" * 64


def chain(rows: DataFrame, by: str, order: str, payload: Column) -> DataFrame:
    """by, order, line, prev_sha256 for each log: every line carries its own payload; the link is the hash of the line before."""
    lines = rows.select(by, order, payload.alias("line"))
    before = F.lag(F.sha2("line", 256), 1, GENESIS).over(Window.partitionBy(by).orderBy(order))
    return lines.withColumn("prev_sha256", before)


def breaks(lines: DataFrame, by: str, order: str) -> DataFrame:
    """by, n, broken_at: for each log, its records and the number of the first that does not fit; null if all do.

    lines: by, order, line (raw), prev_sha256 (as stored). Blank lines do not count; a record that
    is not JSON breaks the log before its link is looked at. The last line can't be vouched for.

    A log of any length is checked by many tasks: rows are dealt by ranges of (by, order), each task checks its stretch of
    each log, and only a row for each stretch, with the link that it begins with and the hash that it ends with, meets those beside it.
    """
    rows = lines.filter("trim(line) <> ''").select(by, order, F.try_parse_json("line").isNotNull().alias("json"), F.col("prev_sha256").alias("link"), F.sha2("line", 256).alias("hash"))
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    long, text = LongType(), StringType()
    schema = StructType([StructField(by, kinds[by]), StructField("first", kinds[order]), StructField("n", long), StructField("bad", long), StructField("fine", BooleanType()), StructField("link", text), StructField("hash", text)])
    dealt = rows.repartitionByRange(by, order).sortWithinPartitions(by, order)
    stretches = dealt.mapInArrow(functools.partial(stretches_of, names=schema.names), schema)
    w = Window.partitionBy(by).orderBy("first")
    at = stretches.withColumns({"offset": F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "want": F.lag("hash", 1, GENESIS).over(w)})
    broken = F.when(~F.col("fine") | ~F.col("link").eqNullSafe(F.col("want")), F.col("offset") + 1).otherwise(F.col("offset") + F.col("bad"))
    return at.groupBy(by).agg(F.sum("n").alias("n"), F.min(broken).cast("int").alias("broken_at"))


def stretches_of(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """A row for each stretch of a log in one task's sorted rows (log, order, json, link, hash).

    It has its first order, its number of rows, the number of the first row after its first that doesn't fit, whether its first is JSON and with what link, and its last hash.
    """
    held: list | None = None
    out: list[list] = []
    kinds: list[pa.DataType] = []
    for batch in batches:
        kinds = [batch.schema.field(0).type, batch.schema.field(1).type, pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string()]
        for log, order, json, link, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held is None or held[0] != log:
                held = [log, order, 1, None, json, link, digest]
                out.append(held)
            else:
                held[2] += 1
                if held[3] is None and not (json and link == held[6]):
                    held[3] = held[2]
                held[6] = digest
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def fingerprint(rows: DataFrame, by: str, *columns: str) -> DataFrame:
    """by, sha256 of a document's rows in canonical form: sorted, nulls written out."""
    part = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("<null>")) for c in columns])
    return rows.groupBy(by).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(part)), "\n"), 256).alias("sha256"))
