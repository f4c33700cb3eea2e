"""Tables of documents that are replaced together, and a cache of computed results: files below a shared folder, with a commit of their own.

A commit is one small file with the number after the last (``manifest/00000007``): it names the folder of each bucket of each table. It is made only
when all data stands, and only if no one else made that number; a failed or overtaken write changes nothing that readers see.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from proofline.functions.sizes import NARROW, spread, tasks

#: Folders over which a table's documents are dealt by a hash of their key.
BUCKETS = 64


def _fs(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    place, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def _create(spark: SparkSession, path: str, text: str) -> None:
    """Writes a new file; an error if it is there already."""
    place, fs = _fs(spark, path)
    out = fs.create(place, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def manifest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """The number of the last commit and what it names; 0 and nothing for a new folder."""
    names = [n for n in _names(spark, f"{path}/manifest") if n.isdigit()]
    if not names:
        return 0, {}
    return int(names[-1]), json.loads(spark.read.text(f"{path}/manifest/{names[-1]}", wholetext=True).first()[0])


def read(spark: SparkSession, path: str, name: str, state: dict | None = None) -> DataFrame | None:
    """A table as the last commit (or ``state``) has it, with the column that says its bucket left out; None for one never written."""
    state = manifest(spark, path)[1] if state is None else state
    if name not in state:
        return None
    schema = StructType.fromJson(state[name]["schema"])
    folders = sorted(set(state[name]["buckets"].values()))
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def ingest(spark: SparkSession, path: str, tables: dict[str, DataFrame], key: str = "doc_id", buckets: int = BUCKETS, rows: int = 0) -> int:
    """Replaces documents in all ``tables`` at once; returns the number of the commit.

    The first table (reports) says which documents come: what the store holds of them goes from every table, also where a document has
    no rows any more. Only buckets of these documents are rewritten. If another writer commits meanwhile, this one fails and changes nothing.
    Rows without a key are added, and never replaced. ``rows``: how many the largest table brings, about; beyond ``sizes.NARROW`` for each bucket, several tasks
    write a bucket's files, a part of its keys each.
    """
    number, state = manifest(spark, path)
    place = lambda n: F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(n)).cast("int")
    keys = next(iter(tables.values())).select(key)
    touched = sorted(r[0] for r in keys.select(place(buckets)).distinct().collect())  # ``buckets`` numbers at most
    after, version = dict(state), f"{path}/data/{number + 1:08d}-{uuid.uuid4().hex}"
    for name, fresh in tables.items():
        table, held = fresh, state.get(name, {}).get("buckets", {})
        mine = {k: v for k, v in held.items() if int(k) in touched}
        if mine:
            old = read(spark, path, name, {name: {"schema": state[name]["schema"], "buckets": mine}})
            total = max(rows, old.count())  # from the files' footers
            table = spread(old, total, key, each=NARROW).join(spread(keys, total, key, each=NARROW), key, "left_anti").unionByName(fresh)
        n = tasks(spark, rows, NARROW)
        n = min(n, buckets) * -(-n // buckets)  # a task has whole buckets, or a bucket whole tasks
        table.withColumn("bucket_", place(buckets)).repartitionById(n, F.pmod(place(max(n, buckets)), F.lit(n))).write.partitionBy("bucket_").parquet(f"{version}/{name}")
        written = {n.split("=")[1]: f"{version}/{name}/{n}" for n in _names(spark, f"{version}/{name}") if n.startswith("bucket_=")}
        after[name] = {"schema": fresh.schema.jsonValue(), "buckets": {k: v for k, v in held.items() if int(k) not in touched} | written}
    _create(spark, f"{path}/manifest/{number + 1:08d}", json.dumps(after))
    return number + 1


def cached(wanted: DataFrame, path: str, key: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """key and result of every wanted row: those computed before from the cache, the others computed in one batch and stored beside them.

    wanted: key (a hash of the content, so equal keys mean equal results) and what ``compute`` needs; ``compute`` gives a row of key and results for each row.
    Each run that has misses adds a batch of its own, which counts once it stands whole; where two runs meet, both compute, and the
    first batch by name is read. Null keys have no result.
    """
    spark = wanted.sparkSession

    def whole() -> list[str]:
        return [f"{path}/{n}" for n in _names(spark, path) if n.startswith("batch-") and "_SUCCESS" in _names(spark, f"{path}/{n}")]

    known = wanted.filter(F.col(key).isNotNull())
    stored = whole()
    misses = known.dropDuplicates([key])
    if stored:
        misses = misses.join(spark.read.parquet(*stored).select(key).distinct(), key, "left_anti")
    if not misses.isEmpty():
        compute(misses).write.parquet(f"{path}/batch-{uuid.uuid4().hex}")
    stored = whole()
    if not stored:
        return compute(misses)
    found = spark.read.parquet(*stored)
    others = F.struct(*[c for c in found.columns if c != key]).alias("row_")
    one = found.select(key, others, F.input_file_name().alias("file_")).groupBy(key).agg(F.min_by("row_", "file_").alias("row_")).select(key, "row_.*")
    return known.select(key).distinct().join(one, key)
