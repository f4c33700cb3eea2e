"""Operator 11: vectors as short codes, by product quantisation in whole numbers.

Components become integers (floor of ``SCALE`` times the value), and each vector is cut into parts. The
codebooks of integers are broadcast; a task computes the squared distances of its Arrow batches to all
entries by norm expansion (|v|^2 - 2 v.c + |c|^2) with int64 matrix products, which are exact, and takes the
first smallest. It adds up the parts of each entry, and Spark sums these by entry and position; only the sums
(at most ``ENTRIES`` times a vector's length) reach the driver, which replaces the entries by floors of means.
A codebook is the size of ``ENTRIES`` vectors, so its broadcast doesn't grow with the rows.

Where squares might leave 64 bits (components of about 2**19 and more), a batch is worked on with
Python's whole numbers, by the same expressions; sums travel in two halves, so they stay exact too.

Labels' sums are joined back with the labels that hold more than a thousandth of all rows (a thousand at most)
broadcast, all others shuffled, so no label gathers in one task.

Results for odd input: vectors that are null or hold null or non-finite components are dropped; rows whose id is
null are kept, and come after all others in a codebook's start; rows that share an id are rows of their own (in a
codebook's start in the order of their packed components); vectors of different lengths are compressed apart, with
codebooks of their own; a length that the parts don't divide is filled up with zeros; a vector without components has
code 0 and error 0; fewer vectors than entries give a shorter codebook; components of a magnitude of 2**53 or more count as the double just below it;
an error or a sum of errors that no long can hold is null; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from proofline.llm import store

#: Fixed values of the query.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Numbers of a distance matrix computed at once.
TILE = 1 << 20
MOST = (1 << 63) - 1
#: Labels with more than one of so many rows are hot.
HOT = 1000


def whole(x: np.ndarray) -> np.ndarray:
    """floor(1024 x) as int64, exactly."""
    limit = np.nextafter(float(1 << 53), 0)  # so that no negation overflows
    return np.floor(np.clip(x, -limit, limit) * SCALE).astype(np.int64)


def integers(vectors: DataFrame, parts: int, key: str, vector: str, label: str) -> DataFrame:
    """vec_id, label, width, ints of usable rows: components as int64 bytes, filled up to ``parts`` times ``width``."""
    v = F.col(vector).cast("array<double>")
    usable = F.col(vector).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.filter(F.coalesce(usable, F.lit(False))).select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), v.alias("v"))
    schema = StructType([StructField("vec_id", LongType()), StructField("label", kept.schema["label"].dataType), StructField("width", IntegerType()), StructField("ints", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in store.slices(batches):
            column = batch.column(2)
            ends, flat = np.asarray(column.offsets), whole(np.asarray(column.flatten()))
            ends = ends - ends[0]
            widths = -(-np.diff(ends) // parts)
            fill = [b"\0" * (8 * n) for n in range(parts)]
            ints = [flat[a:b].tobytes() + fill[parts * w - (b - a)] for a, b, w in zip(ends[:-1].tolist(), ends[1:].tolist(), widths.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(widths, pa.int32()), pa.array(ints, pa.binary())], ["vec_id", "label", "width", "ints"])

    return kept.mapInArrow(run, schema)


def matrix(rows: list[bytes], parts: int, width: int) -> np.ndarray:
    """The parts of packed vectors: rows, parts, width."""
    flat = np.frombuffer(b"".join(rows), "<i8") if width and rows else np.zeros(0, np.int64)
    return flat.reshape(len(rows), parts, width)


def nearest(v: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the first of the nearest entries and its squared distance, exactly."""
    if v.size and v.shape[1] * (int(np.abs(v).max()) + int(np.abs(book).max())) ** 2 > MOST // 2:
        v, book = v.astype(object), book.astype(object)
    far = (v * v).sum(axis=1)[:, None] - 2 * (v @ book.T) + (book * book).sum(axis=1)[None, :]
    first = far.argmin(axis=1)
    return first, far[np.arange(len(v)), first]


def assigned(rows: list[bytes], books: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Parts, codes (rows, parts) and distances of each part, a block of rows at a time."""
    entries, width = books[0].shape
    step = max(1, TILE // entries)
    for at in range(0, len(rows), step):
        v = matrix(rows[at : at + step], len(books), width)
        found = [nearest(v[:, p], book) for p, book in enumerate(books)]
        yield v, np.stack([x[0] for x in found], axis=1), [x[1] for x in found]


def start(ints: DataFrame, parts: int, entries: int, width: int) -> list[np.ndarray]:
    """The first codebooks: the parts of the ``entries`` smallest ids. Their ids come first, alone, so that few vectors travel."""
    order = F.col("vec_id").asc_nulls_last()
    ids = [r[0] for r in ints.select("vec_id").orderBy(order).limit(entries).collect()]
    few = ints if ids[-1] is None else ints.filter(F.col("vec_id") <= ids[-1])
    rows = [bytes(r[0]) for r in few.orderBy(order, "ints").limit(entries).select("ints").collect()]
    v = matrix(rows, parts, width)
    return [v[:, p] for p in range(parts)]


def improved(spark: SparkSession, ints: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Each entry becomes the floor of the mean of the parts nearest to it; one without parts stays."""
    sent = spark.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        entries, width = books[0].shape
        halves, n = np.zeros((2, len(books), entries, width), np.int64), np.zeros((len(books), entries), np.int64)
        for batch in batches:
            for v, codes, _ in assigned(batch.column(0).to_pylist(), books):
                for p in range(len(books)):
                    np.add.at(n[p], codes[:, p], 1)
                    np.add.at(halves[0, p], codes[:, p], v[:, p] >> 32)
                    np.add.at(halves[1, p], codes[:, p], v[:, p] & 0xFFFFFFFF)
        part, entry = np.nonzero(n)
        at = np.tile(np.arange(width, dtype=np.int32), len(part))
        columns = [np.repeat(x, width) for x in (part.astype(np.int32), entry.astype(np.int32))] + [at]
        columns += [halves[i, part, entry].reshape(-1) for i in (0, 1)] + [np.repeat(n[part, entry], width)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "entry", "at", "high", "low", "n"])

    sums = ints.select("ints").mapInArrow(run, "part int, entry int, at int, high long, low long, n long").groupBy("part", "entry", "at")
    found = sums.agg(*(F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("high", "low")), F.sum("n").alias("n")).collect()
    sent.destroy()
    books = [b.copy() for b in books]
    for r in found:
        books[r["part"]][r["entry"], r["at"]] = ((int(r["high"]) << 32) + int(r["low"])) // r["n"]
    return books


def codes(spark: SparkSession, ints: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code, error, codebooks_sha256 of each row of one length."""
    sent = spark.sparkContext.broadcast(books)
    digest = hashlib.sha256(",".join(str(x) for book in books for x in book.reshape(-1).tolist()).encode()).hexdigest()
    schema = StructType([StructField("vec_id", LongType()), ints.schema["label"], StructField("code", StringType()), StructField("error", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, errors = [], []
            for _, found, far in assigned(batch.column(2).to_pylist(), sent.value):
                text, size = found.astype(np.uint8).tobytes().hex(), 2 * found.shape[1]
                names += [text[i : i + size] for i in range(0, len(text), size)]
                errors += [e if e <= MOST else None for e in sum(x.astype(object) for x in far).tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    return ints.select("vec_id", "label", "ints").mapInArrow(run, schema).withColumn("codebooks_sha256", F.lit(digest))


def with_label_errors(rows: DataFrame) -> DataFrame:
    """``rows`` with the sum of error over equal labels (nulls together); null where one is null or the sum leaves a long."""
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    by_label = rows.groupBy("label").agg(F.count("*").alias("n"), F.when(F.count("error") == F.count("*"), total).try_cast("long").alias("label_error"))
    by_label = store.table(by_label.withColumnRenamed("label", "of"), "labels")
    most = rows.count() / HOT
    hot, cold = (by_label.filter(c).select("of", "label_error") for c in (F.col("n") > most, F.col("n") <= most))
    same = F.col("label").eqNullSafe(F.col("of"))
    first = rows.join(F.broadcast(hot), same)  # fewer than ``HOT`` labels
    rest = rows.join(F.broadcast(hot), same, "left_anti").join(cold, same)
    return first.unionByName(rest).drop("of")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable vector."""
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("a code has two hexadecimal digits for each part, so a codebook has 256 entries at most")
    spark = vectors.sparkSession
    ints = store.table(integers(vectors, parts, key, vector, label), "integers")
    found = None
    for width in sorted(r["width"] for r in ints.select("width").distinct().collect()):
        one = ints.filter(F.col("width") == width)
        books = start(one, parts, entries, width)
        for _ in range(rounds):
            books = improved(spark, one, books)
        coded = codes(spark, one, books)
        found = coded if found is None else found.unionByName(coded)
    if found is None:
        found = spark.createDataFrame([], StructType([StructField("vec_id", LongType()), ints.schema["label"], StructField("code", StringType()), StructField("error", LongType()), StructField("codebooks_sha256", StringType())]))
    return with_label_errors(store.table(found, "codes")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def oracle(table: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """DuckDB SQL for ``compress``, of vectors of one length that ``parts`` divides."""
    kept = f"""
        k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM {table} WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        w AS MATERIALIZED (SELECT vec_id, label, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS v FROM k, range({parts}) r(p)),
        b0 AS MATERIALIZED (SELECT p, nth - 1 AS e, v FROM (SELECT p, v, row_number() OVER (PARTITION BY p ORDER BY vec_id) AS nth FROM w) WHERE nth <= {entries})"""
    near = lambda i: f"""
        a{i} AS MATERIALIZED (SELECT vec_id, label, p, v, one.e AS e, one.d AS d FROM (SELECT vec_id, w.p, any_value(label) AS label, any_value(w.v) AS v, min({{'d': list_inner_product(w.v, w.v) - 2 * list_inner_product(w.v, b.v) + list_inner_product(b.v, b.v), 'e': b.e}}) AS one
            FROM w JOIN b{i} b ON w.p = b.p GROUP BY vec_id, w.p))"""  # noqa: E731
    step = lambda i: f"""
        m{i} AS (SELECT p, e, list(x ORDER BY pos) AS v FROM (SELECT p, e, pos, floor(sum(x::HUGEINT)::DOUBLE / count(*)) AS x FROM (SELECT p, e, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{i}) GROUP BY p, e, pos) GROUP BY p, e),
        b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{i} b LEFT JOIN m{i} m ON b.p = m.p AND b.e = m.e)"""  # noqa: E731
    tables = ",".join([kept, *(f"{near(i)},{step(i)}" for i in range(rounds)), near(rounds)])
    return f"""
        WITH {tables},
        h AS (SELECT sha256(string_agg(list_aggregate(list_transform(v, lambda x: x::BIGINT::VARCHAR), 'string_agg', ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds}),
        c AS (SELECT vec_id, any_value(label) AS label, string_agg(lower(printf('%02x', e::INT)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c, h
    """
