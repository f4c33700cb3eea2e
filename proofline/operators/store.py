"""Evidence store: exact readings and findings, held rows, and the rule queries over them.

Readings have doc_id, cml_id, equipment_tag, previous_mm, current_mm, min_required_mm (text as
read) and review_status. A row that needs review is held: it is left out by default, and counted.
A null status is not held.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions.exact import bare, exact

HELD = "needs review"


def held(status: Column) -> Column:
    return status.eqNullSafe(F.lit(HELD))


def reviewed(readings: DataFrame, include_unreviewed: bool = False) -> DataFrame:
    """Readings that a query may use."""
    return readings if include_unreviewed else readings.filter(~held(F.col("review_status")))


def held_count(readings: DataFrame, include_unreviewed: bool = False) -> DataFrame:
    """How many rows of the whole store were left out: one row, 0 if none are left out on purpose."""
    n = F.lit(0).cast("long") if include_unreviewed else F.count_if(held(F.col("review_status")))
    return readings.agg(n.alias("held"))


def below_minimum(readings: DataFrame, include_unreviewed: bool = False) -> DataFrame:
    """Readings strictly below their minimum, with the exact shortfall. Nulls are never guessed: such rows are skipped."""
    current, least = exact(F.col("current_mm")), exact(F.col("min_required_mm"))
    rows = reviewed(readings, include_unreviewed).withColumn("shortfall_mm", (least - current).cast("decimal(18,6)"))
    return rows.filter(F.col("shortfall_mm") > 0)


def thickness_grew(readings: DataFrame, include_unreviewed: bool = False) -> DataFrame:
    """Readings above the one before, which metal does not do."""
    grown = (exact(F.col("current_mm")) - exact(F.col("previous_mm"))).cast("decimal(18,6)")
    return reviewed(readings, include_unreviewed).withColumn("grew_by", grown).filter(F.col("grew_by") > 0)


def in_order(rows: DataFrame, value: str) -> DataFrame:
    """Largest value first, then tag (null as empty) and location."""
    return rows.orderBy(F.desc(value), F.coalesce("equipment_tag", F.lit("")), "doc_id", "cml_id")


def find_findings(findings: DataFrame, severity: str | None = None, tag: str | None = None, clause: str | None = None) -> DataFrame:
    """Findings by severity and tag (any case) and by part of a clause; both sides of a clause are compared bare."""
    if severity is not None:
        findings = findings.filter(F.lower("severity") == severity.lower())
    if tag is not None:
        findings = findings.filter(F.lower("equipment_tag") == tag.lower())
    if clause is not None:
        findings = findings.filter(bare(F.col("ref_clause")).contains(bare(F.lit(clause))))
    return findings


def history(reports: DataFrame, readings: DataFrame, findings: DataFrame, include_unreviewed: bool = True) -> DataFrame:
    """Each report with its readings and findings nested, in one pass over each table."""
    nested = lambda df, key, name, *cols: df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    r = nested(reviewed(readings, include_unreviewed), "doc_id", "readings", "cml_id", "current_mm", "min_required_mm", "review_status")
    f = nested(findings, "doc_id", "findings", "finding_id", "severity")
    none = lambda name: F.coalesce(F.col(name), F.array())
    return reports.join(r, "doc_id", "left").join(f, "doc_id", "left").withColumns({"readings": none("readings"), "findings": none("findings")})


def replace_by_key(stored: DataFrame, fresh: DataFrame, key: str = "doc_id") -> DataFrame:
    """The store after an ingest: every stored row of a document that comes again gives way to the fresh ones."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def ingest(fresh: DataFrame, path: str, key: str = "doc_id") -> None:
    """Writes rows so that a document's partition is replaced as a whole and others stay."""
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


#: What of a reading may leave the store.
EXPORTED = ("cml_id", "location", "nominal_mm", "previous_mm", "current_mm", "min_required_mm", "review_status")


def snapshot(readings: DataFrame, include_unreviewed: bool = False, columns: tuple[str, ...] = ("cml_id", "current_mm", "min_required_mm")) -> DataFrame:
    """doc_id, rows as JSON with the strings as read (nulls kept), and how many of the document's rows were held.

    ``columns``, in their order, are those exported; any that is not on the list of what may leave is an error.
    """
    barred = [c for c in columns if c not in EXPORTED]
    if barred or not columns:
        raise ValueError(f"not for export: {', '.join(barred) or 'nothing named'}")
    row = F.struct(*columns)
    keep = F.lit(True) if include_unreviewed else ~held(F.col("review_status"))
    rows = F.array_sort(F.collect_list(F.when(keep, row)))
    return readings.groupBy("doc_id").agg(F.to_json(rows, {"ignoreNullFields": "false"}).alias("rows"), F.count_if(~keep).alias("held"))


def missing_from(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """What a cache of computed results lacks, once for each key."""
    return wanted.join(cache, key, "left_anti").dropDuplicates([key])


def with_previous(readings: DataFrame, item: str, *order: str) -> DataFrame:
    """Adds previous_mm: the reading of the same item before, by a total order."""
    return readings.withColumn("previous_mm", F.lag("current_mm").over(Window.partitionBy(item).orderBy(*order)))
