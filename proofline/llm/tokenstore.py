"""Operator 8: token-id files of directly addressable codes.

Ids are cut into chunks of eight bits. Level 0 holds every id's lowest chunk, level k the
next chunk of those ids that have one; a bitmap beside each level says which ids go on, and a
rank directory holds the number of set bits before every 512th. The token at any position is
then found with one look at each level, and so is any run of tokens, without decoding blocks.

A file set is a Parquet table in the shared folder, one row for each shard: the documents of a
range of ids, in ascending order, with their codes. Any Spark reader can open it, wherever it lies.

Results for odd input: a null or empty text has the end id alone; rows with the same id stand
side by side, ordered by text; an empty table gives no shard and no row; other columns are
ignored, whatever their names. Null ids come first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm import libtokens, store

#: Tokens after which a shard ends (at a document's end).
SHARD = 1 << 20
BLOCK = 512
FILES = "part long, shard long, start long, n_tokens long, n_docs long, doc_ids binary, lengths binary, codes binary"


def _bits(bitmap: np.ndarray, a: int, b: int) -> np.ndarray:
    return np.unpackbits(bitmap[a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 : (a & 7) + b - a]


class Codes:
    """Directly addressable codes of one shard."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int):
        self.levels, self.n = levels, n

    @classmethod
    def of(cls, ids: np.ndarray) -> Codes:
        levels, rest, n = [], ids.astype(np.uint32), len(ids)
        while True:
            more = rest > 0xFF
            bitmap = np.packbits(more, bitorder="little")
            ones = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
            ranks = np.concatenate([[0], np.cumsum(ones)]).astype("<u4")
            levels.append(((rest & 0xFF).astype(np.uint8), bitmap, ranks))
            if not more.any():
                return cls(levels, n)
            rest = rest[more] >> 8

    def to_bytes(self) -> bytes:
        parts = [a for level in self.levels for a in level]
        head = np.array([self.n, len(self.levels), *(a.nbytes for a in parts)], "<i8")
        return head.tobytes() + b"".join(a.tobytes() for a in parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> Codes:
        n, k = np.frombuffer(data, "<i8", 2).tolist()
        sizes = np.frombuffer(data, "<i8", 3 * k, 16).tolist()
        at, parts = 16 + 24 * k, []
        for i, size in enumerate(sizes):
            parts.append(np.frombuffer(data, "<u4" if i % 3 == 2 else np.uint8, size // (4 if i % 3 == 2 else 1), at))
            at += size
        return cls([tuple(parts[i : i + 3]) for i in range(0, 3 * k, 3)], n)

    def rank(self, level: int, at: int) -> int:
        """How many of the first ``at`` codes of a level go on."""
        _, bitmap, ranks = self.levels[level]
        whole = at // BLOCK
        return int(ranks[whole]) + int(_bits(bitmap, whole * BLOCK, at).sum())

    def get(self, at: int) -> int:
        """The id at a position."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        value, level = 0, 0
        while True:
            chunks, bitmap, _ = self.levels[level]
            value |= int(chunks[at]) << 8 * level
            if not bitmap[at >> 3] >> (at & 7) & 1:
                return value
            at, level = self.rank(level, at), level + 1

    def slice(self, a: int, b: int) -> np.ndarray:
        """The ids at positions a to b - 1, as little-endian unsigned 32-bit integers."""
        out = np.zeros(b - a, "<u4")
        where = None
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            got = chunks[a:b].astype(np.uint32) << np.uint32(8 * level)
            if where is None:
                out += got
            else:
                out[where] += got
            more = np.flatnonzero(_bits(bitmap, a, b))
            if not len(more):
                break
            where = more if where is None else where[more]
            a = self.rank(level, a)
            b = a + len(more)
        return out


def write_tokens(docs: DataFrame, path: str, end_id: int = 1, shard: int = SHARD) -> DataFrame:
    """Encode, append ``end_id`` to each document and write the file set; returns its rows as read back.

    ``start`` in a row counts the ids before the shard in its part; ``with_starts`` adds the parts before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = libtokens.ready(path), np.array([end_id], "<u4").tobytes()
        ids, got, held, part, start, number = [], [], 0, 0, 0, 0

        def flush() -> pa.RecordBatch:
            flat = np.frombuffer(b"".join(got), "<u4")
            lengths = np.array([len(x) // 4 for x in got], "<i8")
            row = [[part], [number], [start], [len(flat)], [len(ids)], [pa_ids(ids)], [lengths.tobytes()], [Codes.of(flat).to_bytes()]]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if i > 4 else pa.int64()) for i, x in enumerate(row)], [x.split()[0] for x in FILES.split(", ")])

        for batch in store.slices(batches):
            for doc, text, here in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                part = here
                ids.append(doc)
                got.append(tokens.encode(text) + end)
                held += len(got[-1]) // 4
                if held >= shard:
                    yield flush()
                    ids, got, start, held, number = [], [], start + held, 0, number + 1
        if ids:
            yield flush()

    n = store.partitions(docs.sparkSession)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return store.table(ordered.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(run, FILES), "tokens")


NO_ID = -(1 << 63)


def pa_ids(ids: list[int | None]) -> bytes:
    return np.array([NO_ID if x is None else x for x in ids], "<i8").tobytes()


def part_starts(files: DataFrame) -> dict[int, int]:
    """Ids before each part. One number for each part reaches the driver, not one for each document or shard."""
    rows = sorted(files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    starts, total = {}, 0
    for part, n in rows:
        starts[part] = total
        total += n
    return starts


def read_documents(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone."""
    starts = part_starts(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                codes, lengths = Codes.from_bytes(row["codes"]), np.frombuffer(row["lengths"], "<i8")
                ends = np.cumsum(lengths)
                flat = [zlib.crc32(codes.slice(b - n, b).tobytes()) for n, b in zip(lengths.tolist(), ends.tolist(), strict=True)]
                ids = np.frombuffer(row["doc_ids"], "<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=ids == NO_ID), pa.array(ends - lengths + row["start"] + starts[row["part"]]), pa.array(lengths), pa.array(flat, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return files.select("part", "start", "doc_ids", "lengths", "codes").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_at(files: DataFrame, positions: DataFrame, column: str = "position") -> DataFrame:
    """The id at each global position, by random access into its shard; positions outside give no row."""
    starts = part_starts(files)
    bases = files.sparkSession.createDataFrame(sorted(starts.items()) or [(0, 0)], "part long, base long")
    shards = files.join(bases, "part").select((F.col("base") + F.col("start")).alias("a"), "n_tokens", "codes")
    step = SHARD
    wanted = positions.select(F.col(column).cast("long").alias("position")).withColumn("block", F.floor(F.col("position") / step))
    blocks = F.explode(F.sequence(F.floor(F.col("a") / step), F.floor((F.col("a") + F.col("n_tokens") - 1) / step)))
    near = shards.filter("n_tokens > 0").withColumn("block", blocks)
    joined = wanted.join(near, "block").filter("position >= a and position < a + n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, last, codes = [], None, None
            for row in batch.to_pylist():
                if row["a"] != last:
                    last, codes = row["a"], Codes.from_bytes(row["codes"])
                rows.append(codes.get(row["position"] - row["a"]))
            yield pa.RecordBatch.from_arrays([batch.column("position"), pa.array(rows, pa.int64())], ["position", "id"])

    return joined.select("position", "a", "codes").mapInArrow(run, "position long, id long")


def token_store(docs: DataFrame, path: str) -> DataFrame:
    """Write the file set of ``docs`` and read every document back from it."""
    return read_documents(write_tokens(docs, path))
