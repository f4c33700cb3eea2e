"""Operator 6: nearest neighbours by a block matrix join with int8 tiles.

Vectors are scaled to unit length and rounded to int8 with a scale of their own. The product of
a block of queries and a block of candidates is then a matrix product of small whole numbers
(done by a float32 routine, in which such sums are exact); what rounding took away is bounded for
each pair by the lengths of the two remainders. Only pairs whose upper bound reaches the query's
k-th best lower bound so far are computed again in double precision, and heaps merge each block's
survivors. Nothing is lost: the result equals brute force, so recall is 1.

Queries and candidates are packed into blocks of one length of vectors, written to the shared
folder, and dealt to a grid: a task holds one group of query blocks (``QUERY_BYTES``) and streams one
group of candidate blocks past it. Neither side passes through the driver.

Results for odd input: vectors that are null or zero or that hold null or non-finite components
take no part; vectors of different lengths are never compared; each query row is answered on its
own, so rows that share a query's id are answered one by one, and are candidates for each other: a
query leaves out just one row that equals it in id and vector, itself. Such answers to queries of
one id stand side by side; ties go to the smaller id; fewer candidates than k give as many rows;
vectors of any length are compared in slices; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofline.llm import store

#: Rows of a block of queries or of candidates, and bytes of the queries that one task holds.
ROWS = 2048
QUERY_BYTES = 32 << 20
#: Bytes of the candidates that one task reads.
CANDIDATE_BYTES = 256 << 20
#: Squared lengths below this have lost digits.
TINY = 1e-280
BLOCK = "dim int, at int, rows int, ids binary, vectors binary"
OUT = "dim int, number long, query_id long, vec_id long, score double, own boolean"


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows whose vector can take part, as doubles."""
    v = F.col(vector).cast("array<double>")
    fine = F.col(key).isNotNull() & F.col(vector).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.filter(F.coalesce(fine, F.lit(False))).select(F.col(key).cast("long").alias("vec_id"), v.alias("v"))


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales, lengths of the remainders and of the rounded vectors, for unit rows."""
    scale = np.abs(v).max(axis=1) / 127
    q = np.rint(v / scale[:, None])
    back = q * scale[:, None]
    return q.astype(np.int8), scale, np.linalg.norm(v - back, axis=1), np.linalg.norm(back, axis=1)


def tile(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The whole-number product of int8 blocks. Sums stay below 2**24 for 1024 components at a time."""
    total = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], 1024):
        total += a[:, k : k + 1024].astype(np.float32) @ b[:, k : k + 1024].astype(np.float32).T
    return total


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by way of the largest component so that no square overflows."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each pair of rows, in double precision on the vectors as they are; scaled first where squares leave the range of doubles."""
    with np.errstate(all="ignore"):
        aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
        found = (a * b).sum(axis=1) / (np.sqrt(aa) * np.sqrt(bb))
        odd = ~np.isfinite(found) | ~((aa > TINY) & (bb > TINY) & (aa < np.inf) & (bb < np.inf))
    if odd.any():
        found[odd] = (unit(a[odd]) * unit(b[odd])).sum(axis=1)
    return found


class Search:
    """The k + 1 best of what has been seen for each query of a block; one of them may be the query itself."""

    def __init__(self, numbers: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.numbers, self.ids, self.vectors, self.k = numbers, ids, vectors, k + 1
        self.q, self.scale, self.rest, self.length = quantise(unit(vectors))
        self.heaps: list[list[tuple[float, int, bool]]] = [[] for _ in ids]
        self.floor = np.full(len(ids), -np.inf)

    def see(self, ids: np.ndarray, vectors: np.ndarray, q: np.ndarray, scale: np.ndarray, rest: np.ndarray, length: np.ndarray) -> None:
        near = tile(self.q, q) * self.scale[:, None] * scale[None, :]
        # |u.v - u'.v'| <= |u - u'| |v| + |u'| |v - v'|, with room for rounding in double precision
        error = self.rest[:, None] + self.length[:, None] * rest[None, :] + 1e-9
        if len(ids) >= self.k:
            self.floor = np.maximum(self.floor, np.partition(near - error, -self.k, axis=1)[:, -self.k])
        at, of = np.nonzero(near + error >= self.floor[:, None])
        for i in range(0, len(at), 1 << 16):
            a, b = at[i : i + (1 << 16)], of[i : i + (1 << 16)]
            scores = cosine(self.vectors[a], vectors[b])
            own = self.ids[a] == ids[b]
            own[own] = (self.vectors[a[own]] == vectors[b[own]]).all(axis=1)
            for r, score, other, same in zip(a.tolist(), scores.tolist(), (-ids[b]).tolist(), own.tolist(), strict=True):
                heap = self.heaps[r]
                if len(heap) < self.k:
                    heapq.heappush(heap, (score, other, same))
                elif (score, other) > heap[0][:2]:
                    heapq.heapreplace(heap, (score, other, same))
        for r in set(at.tolist()):
            if len(self.heaps[r]) == self.k:
                self.floor[r] = max(self.floor[r], self.heaps[r][0][0] - 1e-9)

    def rows(self) -> pa.RecordBatch:
        found = [(self.vectors.shape[1], n, q, -other, score, own) for n, q, heap in zip(self.numbers.tolist(), self.ids.tolist(), self.heaps, strict=True) for score, other, own in heap]
        columns = list(zip(*found, strict=True)) or [[]] * 6
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in OUT.split(", ")])


def blocks(vectors: DataFrame) -> DataFrame:
    """Usable vectors in blocks of ``ROWS`` rows of one length, numbered (``at``) within their task from its own number on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId()
        for batch in batches:
            ids, column = np.asarray(batch.column(0)), batch.column(1)
            lengths, flat = np.diff(np.asarray(column.offsets)), np.asarray(column.flatten())
            for dim in np.unique(lengths).tolist():
                of = lengths == dim
                some, rows = ids[of], flat[np.repeat(of, lengths)].reshape(-1, dim)
                out = [(dim, at + n, len(x), x.tobytes(), y.tobytes()) for n, (x, y) in enumerate((some[i : i + ROWS], rows[i : i + ROWS]) for i in range(0, len(some), ROWS))]
                at += len(out)
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["dim", "at", "rows", "ids", "vectors"])

    return vectors.mapInArrow(run, BLOCK)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of ``vectors`` with the largest cosine for each query."""
    spark = vectors.sparkSession
    wanted = store.table(blocks(usable(queries, key, vector)).withColumn("number", F.monotonically_increasing_id()), "queries")
    candidates = store.table(blocks(usable(vectors, key, vector)), "candidates")
    size = lambda df: df.agg(F.coalesce(F.sum(F.octet_length("vectors")), F.lit(0))).first()[0]
    across = max(1, -(-size(wanted) // query_bytes))
    down = max(1, -(-store.partitions(spark) // across), -(-size(candidates) // CANDIDATE_BYTES))
    deal = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = wanted.select("dim", F.pmod("at", F.lit(across)).alias("i"), deal(down).alias("j"), "number", "ids", "vectors")
    right = candidates.select("dim", deal(across).alias("i"), F.pmod("at", F.lit(down)).alias("j"), F.lit(None).cast("long").alias("number"), "ids", "vectors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, []
        for batch in batches:
            for dim, i, j, number, ids, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (dim, i, j) != place:
                    yield from (s.rows() for s in held)
                    place, held = (dim, i, j), []
                own, rows = np.frombuffer(ids, "<i8"), np.frombuffer(data, "<f8").reshape(-1, dim)
                if number is not None:
                    held.append(Search((number << 11) + np.arange(len(own)), own, rows, k))
                elif held:
                    small = quantise(unit(rows))
                    for search in held:
                        search.see(own, rows, *small)
        yield from (s.rows() for s in held)

    both = left.unionByName(right).repartition(across * down, "dim", "i", "j").sortWithinPartitions("dim", "i", "j", F.col("number").asc_nulls_last())
    found = both.mapInArrow(run, OUT)
    best = Window.partitionBy("dim", "number").orderBy(F.desc("score"), "vec_id", F.desc("own"))
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k + 1)
    # the first row that is the query itself goes; the others move up
    gone = F.min(F.when(F.col("own"), F.col("rank"))).over(Window.partitionBy("dim", "number"))
    left = ranked.withColumn("gone", F.coalesce(gone, F.lit(k + 1))).filter(F.col("rank") != F.col("gone"))
    rank = (F.col("rank") - F.when(F.col("rank") > F.col("gone"), 1).otherwise(0)).cast("int")
    return left.select("query_id", rank.alias("rank"), "vec_id", "score")
