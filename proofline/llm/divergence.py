"""Operator 13: how far the sources of a language diverge in their words, by term-block dense matrices.

Terms are runs of letters A-Z (as a-z) and signs beyond ASCII. A task counts them for each (lang,
source) group in a table of bounded size; counts are summed by Spark before they meet. Kept terms (in
``LEAST`` documents of their language) are dealt to buckets by a hash, so that a large language, a large source
and a common term are spread. A task turns its terms into int64 tiles of groups by terms, block by
block, and computes all pairs of groups of a block by broadcasting; it adds up its pair matrices, and keeps a
heap of the ``TOP`` terms of each group. Matrices are summed and heaps merged by Spark.

Shares are exact whole numbers of 1e-9 (1 + floor(1e9 (n + 1) / (N + V))), by long division in steps of 1,000, so
counts may reach 9e15. Every task gets the totals of all groups of its languages as rows that come before
its terms: nothing is broadcast or collected.

Results for odd input: null text, lang and source count as ''; a group without terms is compared like
others (a value of 0 with every other if its language keeps none); a lone source has no pairs; every row is a document of its
own, whatever its id; texts of any length are read whole, block by block; equal values rank by the item's bytes; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofline.llm import store

#: Fixed values of the query: documents that hold a term, terms listed of each group.
LEAST, TOP = 3, 200
#: Different (group, term) pairs that a task holds, bytes of text taken apart at once, rows of a bucket.
HELD, BLOCK, ROWS = 400_000, 1 << 22, 100_000
#: Numbers of a tile, of what is computed at once, and of a pair matrix held.
TILE = 1 << 20
PAIRS = 1 << 22
#: Counts of a held table are packed: documents above this bit, occurrences below.
BIT = 40

_fold = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(data: bytes) -> Iterator[list[bytes]]:
    """All terms of a text, in lists."""
    at = 0
    while at < len(data):
        end = at + BLOCK
        part = data[at:end].translate(_fold)
        if end < len(data):  # up to the end of a term that goes on
            while end < len(data) and _fold[data[end]] != 32:
                end += 1
            part = data[at:end].translate(_fold)
        yield part.split()
        at = end


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents of each term in each group."""
    text, lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(c) for c in ("text", "lang", "source"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bytes, bytes], dict[bytes, int]] = {}
        size, one = 0, 1 << BIT

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), own in held.items():
                packed = np.fromiter(own.values(), np.int64, len(own))
                names = [pa.array([x] * len(own), pa.binary()) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*names, pa.array(list(own), pa.binary()), pa.array(packed & (one - 1)), pa.array(packed >> BIT)], ["lang", "source", "term", "n", "docs"])

        for batch in store.slices(batches):
            for text, lang, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found: Counter[bytes] = Counter()
                for some in terms(text):
                    found.update(some)
                own = held.setdefault((lang, source), {})
                get, before = own.get, len(own)
                for term, n in found.items():
                    own[term] = get(term, 0) + n + one
                size += len(own) - before
                if size > HELD:
                    yield from out()
                    held, size = {}, 0
        yield from out()

    every = docs.select(text, lang, source).mapInArrow(run, "lang binary, source binary, term binary, n long, docs long")
    found = every.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return found.select(*(F.col(c).cast("string").alias(c) for c in ("lang", "source", "term")), "n", "docs")


def share(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(1e9 n / total), exactly, for 0 < n <= total < 9e15."""
    found = np.zeros(np.broadcast_shapes(n.shape, total.shape), np.int64)
    rest = np.broadcast_to(n, found.shape)
    for _ in range(3):
        part, rest = np.divmod(rest * 1000, total)
        found = found * 1000 + part
    return found + 1


def excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q)."""
    return (p - q) ** 2 // q


def pair_rows(counts: tuple[np.ndarray, np.ndarray, np.ndarray], n_terms: int, totals: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(group, its values against all groups) over all terms. counts: group, term (ascending), occurrences."""
    group, term, n = counts
    groups = len(totals)
    width, step = max(1, TILE // groups), max(1, PAIRS // groups)
    for first in range(0, groups, step):
        sums = np.zeros((min(step, groups - first), groups), np.int64)
        for at in range(0, n_terms, width):
            a, b = np.searchsorted(term, [at, at + width])
            tile = np.zeros((groups, min(width, n_terms - at)), np.int64)
            tile[group[a:b], term[a:b] - at] = n[a:b]
            p = share(tile + 1, totals[:, None])
            some = max(1, PAIRS // p.size)
            for i in range(0, len(sums), some):
                sums[i : i + some] += excess(p[first + i : first + min(i + some, len(sums)), None, :], p[None, :, :]).sum(axis=2)
        yield from zip(range(first, first + len(sums)), sums, strict=True)


def best_terms(counts: tuple[np.ndarray, np.ndarray, np.ndarray], whole: np.ndarray, names: list[bytes], totals: np.ndarray, lang_total: int, top: int) -> dict[int, list[tuple[int, bytes]]]:
    """For each group a heap's worth of (-value, term): the ``top`` first, merged block by block."""
    heaps: dict[int, list[tuple[int, bytes]]] = {}
    for at in range(0, len(whole), TILE):
        group, term, n = (x[at : at + TILE] for x in counts)
        p, q = share(n + 1, totals[group]), share(whole[at : at + TILE] + 1, np.array(lang_total))
        over = p > q
        group, term, value = group[over], term[over], excess(p[over], q[over])
        order = np.lexsort((term, -value, group))  # terms are numbered in the order of their bytes
        group, term, value = group[order], term[order], value[order]
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        for a, b in pairwise([*starts.tolist(), len(group)]):
            new = [(-v, names[t]) for v, t in zip(value[a : min(b, a + top)].tolist(), term[a : min(b, a + top)].tolist(), strict=True)]
            heaps[int(group[a])] = list(islice(heapq.merge(heaps.get(int(group[a]), []), new), top))
    return heaps


OUT = "lang string, g int, term binary, value long, against array<long>"


def diverge(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: each group against the other sources of its language, and its most telling terms."""
    known = Window.partitionBy("lang", "term")
    seen = counted(docs).withColumns({"all": F.sum("docs").over(known), "whole": F.sum("n").over(known), "nth": F.row_number().over(known.orderBy("source"))})
    kept = store.table(seen.filter(F.col("all") >= least).select("lang", "source", "term", "n", "whole", "nth"), "kept")
    names = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    by_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count(F.when(F.col("nth") == 1, 1)).alias("v"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = names.join(own, ["lang", "source"], "left").join(by_lang, "lang", "left").select("lang", "source", number.cast("int").alias("g"), none("n"), none("lang_n"), none("v"))
    groups = store.table(groups, "groups")
    tasks = max(1, -(-kept.count() // ROWS))  # by the rows alone, as each sends a matrix of all pairs
    heads = groups.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("bucket"), "lang", "source", F.lit(None).cast("string").alias("term"), (F.col("n") + F.col("v")).alias("n"), (F.col("lang_n") + F.col("v")).alias("whole"), "g")
    rows = kept.select(F.pmod(F.xxhash64("lang", "term"), F.lit(tasks)).cast("int").alias("bucket"), "lang", "source", "term", "n", "whole", F.lit(None).cast("int").alias("g"))

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        for lang in pc.unique(table.column("lang")).to_pylist():
            here = table.filter(pc.equal(table.column("lang"), pa.scalar(lang)))
            head, body = here.filter(pc.is_valid(here.column("g"))).sort_by("g"), here.filter(pc.is_null(here.column("g")))
            if not len(body):
                continue
            totals, lang_total = np.asarray(head.column("n")), head.column("whole")[0].as_py()
            words = pc.unique(body.column("term").cast(pa.binary()))
            words = words.take(pc.sort_indices(words))
            term = np.asarray(pc.index_in(body.column("term").cast(pa.binary()), value_set=words).combine_chunks())
            group = np.asarray(pc.index_in(body.column("source"), value_set=head.column("source").combine_chunks()).combine_chunks())
            order = np.argsort(term, kind="stable")
            counts = group[order], term[order], np.asarray(body.column("n"))[order]
            sums = ((g, None, None, row) for g, row in pair_rows(counts, len(words), totals))
            while some := list(islice(sums, max(1, PAIRS // len(totals)))):
                yield batch(lang, some)
            heaps = best_terms(counts, np.asarray(body.column("whole"))[order], words.to_pylist(), totals, lang_total, top)
            yield batch(lang, [(g, t, -minus, None) for g, heap in heaps.items() for minus, t in heap])

    def batch(lang: str, rows: list[tuple]) -> pa.RecordBatch:
        g, term, value, against = zip(*rows, strict=True) if rows else ([], [], [], [])
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(rows), pa.string()), pa.array(g, pa.int32()), pa.array(term, pa.binary()), pa.array(value, pa.int64()), pa.array(against, pa.list_(pa.int64()))], ["lang", "g", "term", "value", "against"]
        )

    found = store.table(store.by_bucket(heads.unionByName(rows), "bucket", tasks, run, OUT), "blocks")
    sums = found.filter("against is not null").select("lang", "g", F.posexplode("against").alias("of", "value")).groupBy("lang", "g", "of").agg(F.sum("value").alias("value"))
    one, other = groups.select("lang", "source", "g"), groups.select("lang", F.col("source").alias("item"), F.col("g").alias("of"))
    pairs = one.join(other, "lang").filter("g <> of").join(sums, ["lang", "g", "of"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    # the first of each group, before names are joined
    first = Window.partitionBy("lang", "g").orderBy(F.desc("value"), "term")
    best = found.filter("term is not null").withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= top)
    best = best.join(one, ["lang", "g"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value", "rank")
    return pairs.unionByName(best)


def oracle(table: str, least: int = LEAST, top: int = TOP) -> str:
    """DuckDB SQL for ``diverge``."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    share = lambda n, total: f"1 + (1000000000::HUGEINT * ({n} + 1)) // ({total})"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{capitals}', '{capitals.lower()}') AS text FROM {table}),
        w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
        k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= {least}),
        c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
        l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
        o AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
        g AS (SELECT d.lang, d.source, coalesce(o.n, 0) AS n, coalesce(l.v, 0) AS v, coalesce(l.n, 0) AS lang_n FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN o USING (lang, source) LEFT JOIN l USING (lang)),
        p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {share("coalesce(c.n, 0)", "g.n + g.v")} AS p, {share("k.n", "g.lang_n + g.v")} AS q
              FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
        s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
        r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
              UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
        WHERE part = 'pair' OR rank <= {top}
    """
