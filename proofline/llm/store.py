"""Shared-folder tables and ordered ranges used by the operators of this subpackage.

Intermediate results are written as Parquet below ``spark.checkpoint.dir``, which the
driver and every executor can reach, so a lost executor costs a re-read and no lineage.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset, a temporary one in local mode; a cluster needs the setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='proofline-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Lists of the tables made in scopes that are open, innermost last; tables made outside of all, which a result may still be read from.
_open: list[list[str]] = []
_loose: list[tuple[SparkSession, str]] = []
#: Deletes the shuffle files of a write when it has ended; how many rows go to a Python worker at once, and are worked on at once.
CLEANUP, BATCH = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch"
ROWS, SLICE = 2000, 500


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and return it as read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    else:
        _loose.append((spark, path))
    before = {CLEANUP: spark.conf.get(CLEANUP, "false"), BATCH: spark.conf.get(BATCH, "10000")}
    spark.conf.set(CLEANUP, "true")
    spark.conf.set(BATCH, str(min(ROWS, int(before[BATCH])) if int(before[BATCH]) > 0 else ROWS))
    try:
        df.write.parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete the files of tables that ``table()`` made."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for one in paths:
        path = jvm.org.apache.hadoop.fs.Path(one)
        path.getFileSystem(conf).delete(path, True)


@atexit.register
def tidy() -> None:
    """Deletes the tables that belong to no scope, at the latest when the driver's Python ends; what was read from them can't be read again."""
    while _loose:
        spark, path = _loose.pop()
        if spark.sparkContext._jsc is not None:  # else the session is over, and nobody can
            drop(spark, [path])


class Scope:
    """Tables made within, of which ``keep`` names those that outlive it; the others are deleted at its end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.made, self.kept = spark, [], []

    def __enter__(self) -> Scope:
        _open.append(self.made)
        return self

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as a table that stays."""
        found = table(df, name)
        self.kept.append(self.made.pop())
        return found

    def __exit__(self, kind, *_) -> None:
        _open.remove(self.made)
        if kind is None:
            drop(self.spark, self.made)
        if _open:
            _open[-1].extend(self.kept)
        else:
            _loose.extend((self.spark, path) for path in self.kept)


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of a few rows each, after the worker has given back what earlier tasks left."""
    release()
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def release() -> None:
    """Gives memory that a reused worker no longer needs back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def partitions(spark: SparkSession) -> int:
    """How many partitions a shuffle of this session gets."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets(spark: SparkSession, total: int, each: int) -> int:
    """How many buckets hold ``total`` units, ``each`` or so in one; no fewer than the session's partitions."""
    return max(partitions(spark), -(-total // each))


def size_of(df: DataFrame) -> int:
    """Bytes of the input as the optimiser knows them: of files, as they lie there. No job runs."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())


def deal(df: DataFrame, key: str, tasks: int, *order: str) -> DataFrame:
    """Rows in ``tasks`` partitions by a bucket number, evenly, and together in each."""
    return df.repartitionById(tasks, F.pmod(F.col(key), F.lit(tasks)).cast("int")).sortWithinPartitions(key, *order)


def by_bucket(df: DataFrame, key: str, tasks: int, run: Callable[[pa.Table], pa.Table | Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``run`` on all rows of each bucket; what ``groupBy`` and ``applyInArrow`` do, but with buckets dealt evenly."""
    at = df.columns.index(key)

    def out(held: list[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        found = run(pa.Table.from_batches(held))
        return found.to_batches() if isinstance(found, pa.Table) else found

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held, bucket = [], None
        for batch in batches:
            keys = np.asarray(batch.column(at))
            for begin, stop in pairwise([0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]):
                if begin == stop:
                    continue
                if held and keys[begin] != bucket:
                    yield from out(held)
                    held = []
                bucket = keys[begin]
                held.append(batch.slice(begin, stop - begin))
        if held:
            yield from out(held)

    return deal(df, key, tasks).mapInArrow(stream, schema)


def split_points(df: DataFrame, key: str, parts: int) -> list[int]:
    """Ascending upper ends (all but the last) that cut ``key`` into about equal ranges.

    At most ``parts - 1`` numbers reach the driver, however many rows there are.
    """
    if parts < 2:
        return []
    probs = [i / parts for i in range(1, parts)]
    found = df.filter(F.col(key).isNotNull()).approxQuantile(key, probs, 0.2 / parts)
    return sorted({int(x) for x in found})


def range_no(key: str, points: list[int]) -> Column:
    """The index of the range that ``key`` falls into (nulls: range 0), by binary search."""
    if not points:
        return F.lit(0)
    ends = F.array(*[F.lit(x).cast("long") for x in points])
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(points).bit_length()))])
    # a step beyond the last end gives null, and isn't taken
    return F.aggregate(steps, F.lit(0), lambda n, s: F.when(F.get(ends, n + s - 1) < F.col(key), n + s).otherwise(n))
