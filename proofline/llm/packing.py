"""Operator 10: packing by the linear grouping scheme, then best fit.

Lengths are whole numbers up to the capacity, so the whole problem is a histogram of at most
``capacity`` counts, however many documents there are. On it the driver

1. sorts the large lengths, cuts them into groups of equal cardinality and rounds each up to
   its group's largest;
2. optimises configurations of these few sizes: the cutting-stock linear programme by column
   generation, rounded down, and the rest by greedy configurations;
3. substitutes the actual lengths for the rounded ones, longest first within a group;
4. puts the small lengths, longest first, where they fit best, and gives the sequences that
   are not full after that a second chance by best fit.

The plan is a table of runs: pieces of a length with ranks from r to r + k - 1 go to sequences
s to s + k - 1 at one offset. Its size depends on the capacity alone. Documents get their rank
within their length from counts for each task and length, so nothing gathers in one task.

Results for odd input: a null or empty text is the end id alone; repeated rows are packed as
often as they occur; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofline.llm import libtokens, store

CAPACITY = 2048
#: Words in each generation of a worker's memo.
MEMO = 500_000
GROUPS = 128
#: Lengths up to this part of the capacity are small: two large ones fit together at most, which
#: leaves enough small ones to fill what rounding up costs.
SMALL = 0.45
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long"


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, but the first may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((a, capacity) for a in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece; ``nth`` counts the pieces of its length in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = libtokens.ready(path, MEMO), np.array([end_id], "<u4").tobytes()
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64).tolist()
        for batch in store.slices(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = tokens.encode(text) + end
                for k, (a, n) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((doc, k, a, n, zlib.crc32(ids[4 * a : 4 * (a + n)]), task, seen[n]))
                    seen[n] += 1
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, PIECES)


def _knapsack(sizes: list[int], worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable configuration of sizes within the capacity."""
    size = np.array(sizes)
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        fits = size <= c
        if fits.any():
            value = np.where(fits, best[np.maximum(c - size, 0)] + worth, -1.0)
            i = int(value.argmax())
            if value[i] > best[c] + 1e-12:
                best[c], took[c] = value[i], i
    out, c = np.zeros(len(sizes), int), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            out[took[c]] += 1
            c -= sizes[took[c]]
    return float(best[capacity]), out


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[int, list[int]]]:
    """(multiplicity, counts by size) that cover the demand exactly, with few sequences."""
    need, k = np.array(demand, float), len(sizes)
    columns = [np.eye(k, dtype=int)[i] * min(capacity // s, max(1, demand[i])) for i, s in enumerate(sizes)]
    for _ in range(400):
        basis = np.array(columns, float).T
        x = np.linalg.solve(basis, need)
        duals = np.linalg.solve(basis.T, np.ones(k))
        worth, entering = _knapsack(sizes, duals, capacity)
        if worth <= 1 + 1e-7:
            break
        d = np.linalg.solve(basis, entering.astype(float))
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        columns[int(ratio.argmin())] = entering
    left, out = np.array(demand), []

    def put(column: np.ndarray, times: int) -> None:
        if times > 0:
            out.append((times, column.tolist()))
            left[:] -= column * times

    for column, times in sorted(zip(columns, np.floor(x + 1e-9).astype(int).tolist(), strict=True), key=lambda c: -c[1]):
        used = column > 0
        put(column, min(times, int((left[used] // column[used]).min())))
    while left.any():
        room, column = capacity, np.zeros(k, int)
        for i in np.argsort([-s for s in sizes], kind="stable"):
            n = min(int(left[i]), room // sizes[i])
            column[i], room = n, room - n * sizes[i]
        used = column > 0
        put(column, int((left[used] // column[used]).min()))
    return out


def best_fit(lengths: dict[int, int], bins: list[tuple[int, tuple[int, ...]]], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Puts lengths, longest first, into the fullest bins that still hold them; opens bins where none does.

    A bin is (how many alike, lengths in it). Alike bins are filled together.
    """
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    open_rooms: list[int] = []

    def add(count: int, held: tuple[int, ...], free: int) -> None:
        if count:
            if free not in room:
                room[free] = []
                insort(open_rooms, free)
            room[free].append((count, held))

    for count, held in bins:
        add(count, held, capacity - sum(held))
    for length in sorted(lengths, reverse=True):
        n = lengths[length]
        while n:
            k = bisect_left(open_rooms, length)
            if k == len(open_rooms):
                add(max(1, n // (capacity // length)), (), capacity)
                continue
            free = open_rooms[k]
            count, held = room[free].pop()
            if not room[free]:
                del room[free]
                open_rooms.pop(k)
            each = min(free // length, n)
            take = min(count, n // each)
            add(take, held + (length,) * each, free - each * length)
            add(count - take, held, free)
            n -= each * take
    return [x for group in room.values() for x in group]


def grouped(large: list[tuple[int, int]], capacity: int, groups: int) -> list[tuple[int, tuple[int, ...]]]:
    """Bins of the large lengths (longest first) by linear grouping, configurations and substitution."""
    total = sum(n for _, n in large)
    ends = [total * (g + 1) // groups for g in range(groups)]
    pools: dict[int, list[list[int]]] = {}
    g, at, size = 0, 0, None
    for length, n in large:
        while n:
            if at >= ends[g]:
                g, size = next(i for i in range(g, groups) if at < ends[i]), None
            size = size or length
            step = min(n, ends[g] - at)
            pools.setdefault(size, []).append([length, step])
            at, n = at + step, n - step
    sizes, bins = list(pools), []
    for times, counts in configurations(sizes, [sum(n for _, n in pools[s]) for s in sizes], capacity):
        slots = []
        for size, c in zip(sizes, counts, strict=True):
            for _ in range(c):
                got, want, pool = [], times, pools[size]
                while want:
                    step = min(want, pool[0][1])
                    got.append([pool[0][0], step])
                    want, pool[0][1] = want - step, pool[0][1] - step
                    if not pool[0][1]:
                        pool.pop(0)
                slots.append(got)
        while times:
            step = min(s[0][1] for s in slots)
            bins.append((step, tuple(s[0][0] for s in slots)))
            for s in slots:
                s[0][1] -= step
                if not s[0][1]:
                    s.pop(0)
            times -= step
    return bins


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, count, first sequence, offset) for all pieces, and the number of sequences.

    Bins that best fit leaves with room are taken apart and packed once more by best fit
    alone, which is kept if it takes fewer sequences.
    """
    large = [(x, histogram[x]) for x in sorted(histogram, reverse=True) if capacity * SMALL < x < capacity]
    small = {x: n for x, n in histogram.items() if x <= capacity * SMALL}
    bins = best_fit(small, grouped(large, capacity, groups) if large else [], capacity)
    full = [b for b in bins if sum(b[1]) == capacity]
    loose, again = [b for b in bins if sum(b[1]) < capacity], {}
    for count, held in loose:
        for x in held:
            again[x] = again.get(x, 0) + count
    anew = best_fit(again, [], capacity)
    bins = full + min(loose, anew, key=lambda some: sum(n for n, _ in some))
    if n := histogram.get(capacity, 0):
        bins.append((n, (capacity,)))
    runs, used, sequences = [], dict.fromkeys(histogram, 0), 0
    for count, held in bins:
        offset = 0
        for length in held:
            runs.append((length, used[length], count, sequences, offset))
            used[length] += count
            offset += length
        sequences += count if held else 0
    return runs, sequences


def ranked(table: DataFrame) -> DataFrame:
    """Adds ``rank``: the piece's place among all of its length, from counts for each task and length."""
    counts = table.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return table.join(offsets, ["length", "task"]).withColumn("rank", F.col("before") + F.col("nth"))


def place(table: DataFrame, runs: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """Looks each piece's length and rank up in the runs."""
    flat = np.array(sorted(runs) or np.zeros((0, 5)), np.int64).reshape(-1, 5)
    keys = flat[:, 0] << 44 | flat[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        libtokens.forget()
        for batch in batches:
            length, rank = (np.asarray(batch.column(x)) for x in ("length", "rank"))
            at = np.searchsorted(keys, length << 44 | rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(flat[at, 3] + rank - flat[at, 1]), pa.array(flat[at, 4])], [*batch.schema.names[:5], "sequence_id", "offset"])

    return table.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    table = store.table(pieces(docs, path, end_id, capacity), "pieces")
    histogram = dict(table.groupBy("length").count().collect())  # at most ``capacity`` rows
    runs, _ = plan(histogram, capacity)
    return place(ranked(table), runs)
