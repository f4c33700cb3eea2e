"""Guards for what is sent to every task: a side is broadcast only after its size has been checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows that one task of a shuffle by key holds, about.
ROWS = 250_000
#: The same where a row is two or three numbers.
NARROW = 1_000_000


def tasks(spark: SparkSession, rows: int, each: int) -> int:
    """Tasks of a shuffle that so many rows ask for; not fewer than the session's. Spark joins small ones by their compressed bytes, of which keys in order have few, unless their number is given."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def spread(df: DataFrame, rows: int, *keys: str, each: int = ROWS) -> DataFrame:
    """``df`` dealt by its keys over as many tasks as ``rows`` ask for, so that a task's memory doesn't grow with the table; groups and joins by these keys stay there."""
    return df.repartition(tasks(df.sparkSession, rows, each), *keys)


def short(df: DataFrame, most: int) -> DataFrame:
    """``df`` with a broadcast hint; an error, rather than a cut, if it has more rows than a short list may have."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"this side may have {most} rows at most; split it into batches")
    return F.broadcast(df)


def if_few(df: DataFrame, most: int) -> DataFrame:
    """``df`` worked out once and with a broadcast hint if it has ``most`` rows at most; else as it is."""
    rows = df.limit(most + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= most else df
