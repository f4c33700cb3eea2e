"""Operator 5: exact n-gram Jaccard join with set-relation skipping.

Documents are sets of 64-bit shingle hashes; documents with equal sets are one node. Two nodes
link when ``den * |A & B| >= num * |A | B|``.

1. One pass writes (doc_id, size, node) and counts all shingles in a fixed number of slots.
2. Sets that may link are brought together. Sizes fall into classes such that linked sets are
   in one class or in neighbouring ones, so a set takes part in its own class and in the next.
   Linked sets of a class differ in at most D shingles. The hash space is cut into D + 1 + spare
   parts, and a set takes part with its last D + 1 that aren't empty. Each differing shingle spoils one part, so of the set whose
   last D + 1 begin later, one at least is the other's, too, and sent by both. This holds for any choice of shingles, so the frequent ones are left out: those in
   slots of a count of all shingles of all documents that stand out far. A set with too many empty
   parts takes part with all that it has, and with all its shingles, too. Parts travel as signatures of 48 bits and names of 64 in
   packed blocks; a short list of equal ones gives pairs, one of m gives m - 1 edges of candidate clusters. Agreement in a
   part takes a few rare shingles at once, so shared passages seldom make candidates, and
   sketches of the sets turn down most pairs that can't link. The edges of a long list aren't looked at
   by sketches, as its members hang together by them alone, so a popular part makes a large cluster;
   such a one is cut up in step 3. Pairs may grow faster than the documents; they meet the sketches in rounds, of so many for each node.
3. Within a cluster the sets, by size, are joined over index lists. A list is in the order of
   sets and jumps over the block before a set and the block of those too large for it. If a set
   is much like one done before, its overlaps are that one's, changed by the lists of the few
   shingles in which they differ. Clusters are cut into blocks (``blocks_of``), and
   each pair of blocks is a task of its own: exact for any size, in bounded memory. Where large clusters
   would be sent more than ``BLOCKS`` times on average, their pairs of blocks are done in rounds, so the disk doesn't grow with them.

Sets have 128-bit names; shingles are 64 bits, of which ``shingles`` states what may go wrong. Up to the clusters of candidates sets go by
the first half of their names: others of the same half only make a cluster larger, and linked sets that share it are missed with a chance of 2**-64 for each pair. The slots
of the count in step 2 are as many for any corpus: a shingle counts as frequent if its slot stands out by
eight deviations, which at 10**13 shingles takes some 25,000 documents; below that, lists of equal
signatures are no longer than that.

Results for odd input: null, empty and wordless texts have an empty set and are linked with
nothing, each its own component; fewer words than k make one shingle; repeated ids and rows are
kept, each row with its own result; a null id counts as larger than all others; texts of any length are
read whole, in blocks; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.llm import store
from proofline.llm.components import components
from proofline.llm.shingles import mix, set_key, shingle_set, word_hashes

#: Shingles of a cluster in one block: few, until there are ``BLOCKS`` blocks; then more, up to ``CLUSTER``. A set is sent once for
#: each block of its cluster, so blocks are no more than one task's time and memory ask for.
BLOCK, BLOCKS, CLUSTER = 1 << 18, 4, 2_000_000
#: Shingles for each bucket of signatures.
DEALT = 2_000_000
#: Nodes whose ids are sent to every task; above this, the texts are joined by a shuffle.
SEND = 500_000
#: Sets up to this size meet by prefix shingles instead of parts, which would be empty too often.
SMALL = 32
#: Slots in which shingles are counted, and the blocks in which the counts are added up.
SLOT_BITS, CHUNKS = 20, 64
#: Bins of a sketch, and the longest list of equal signatures that is looked at pair by pair.
BINS, PAIRWISE = 64, 24
#: A signature and the first half of the name of its node; how many bytes of a signature are sent, as its bucket says more.
POSTING, SIGN = np.dtype([("sign", "<u8"), ("name", "<u8")]), 6
#: Pairs for each node that are looked at by sketches in one round; a round's shuffle files go when it ends.
PAIRS = 8


def _texts(batch: pa.RecordBatch, column: int, size: int = 512) -> Iterator[tuple[int, list[str]]]:
    for at in range(0, batch.num_rows, size):
        yield at, batch.column(column).slice(at, size).to_pylist()


def describe(docs: DataFrame, k: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, twin, n, node, sketch) of each row, twin telling rows of one id apart; and which slots are frequent."""
    names = ["doc_id", "twin", "n", "node", "sketch", "chunk", "task", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store.release()
        total = np.zeros(1 << SLOT_BITS, np.uint32)
        for batch in batches:
            n, nodes, sketches = [], [], []
            for _, texts in _texts(batch, 2):
                sets = [shingle_set(w, k) for w in word_hashes(texts)]
                n += [len(s) for s in sets]
                nodes += [set_key(s) for s in sets]
                sketches += map(sketch, sets)
                slots, times = np.unique(slot(np.concatenate(sets)), return_counts=True)
                total[slots] += times.astype(np.uint32)
            none = [pa.nulls(batch.num_rows, t) for t in (pa.int32(), pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(nodes, pa.binary()), pa.array(sketches, pa.binary()), *none], names)
        task, none = TaskContext.get().partitionId(), pa.nulls(CHUNKS, pa.int64())
        counts = [x.tobytes() for x in np.split(total, CHUNKS)]
        yield pa.RecordBatch.from_arrays([none, none, none, *[pa.nulls(CHUNKS, pa.binary())] * 2, pa.array(range(CHUNKS), pa.int32()), pa.array([task] * CHUNKS, pa.int32()), pa.array(counts, pa.binary())], names)

    def add(part: pa.Table) -> pa.Table:
        size = (1 << SLOT_BITS) // CHUNKS
        found = sum(np.frombuffer(x, f"<u{len(x) // size}").astype(np.uint64) for x in part.column("counts").to_pylist())
        return pa.table({"chunk": part.column("chunk")[:1], "counts": pa.array([found.tobytes()])})

    rows = docs.select(F.col("doc_id").cast("long"), twin(), "text")
    both = store.table(rows.mapInArrow(run, "doc_id long, twin long, n long, node binary, sketch binary, chunk int, task int, counts binary"), "nodes")
    parts = both.filter("chunk is not null").select("chunk", (F.col("task") % 64).alias("salt"), "counts")
    sums = parts.groupBy("chunk", "salt").applyInArrow(add, "chunk int, counts binary").groupBy("chunk").applyInArrow(add, "chunk int, counts binary")
    total = np.zeros((CHUNKS, (1 << SLOT_BITS) // CHUNKS), np.uint64)
    for chunk, counts in sums.collect():  # 64 blocks of fixed size
        total[chunk] = np.frombuffer(counts, "<u8")
    mean = float(total.mean())
    return both.filter("chunk is null").select("doc_id", "twin", "n", "node", "sketch"), total.reshape(-1) > mean + 8 * mean**0.5 + 32


def sketch(found: np.ndarray) -> bytes:
    """How many of a set's shingles fall into each of ``BINS`` bins, 255 at most: sets differ in no fewer than their sketches."""
    return np.minimum(np.bincount(((found >> np.uint64(8)) % np.uint64(BINS)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes()


def slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def twin() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("twin")


class Classes:
    """Size classes and the number of parts of each."""

    def __init__(self, num: int, den: int, largest: int = 1 << 40):
        self.num, self.den = num, den
        self.ends = [1 * den // num]
        while self.ends[-1] < largest:
            self.ends.append((self.ends[-1] + 1) * den // num)
        self.differ = [2 * end * (den - num) // (den + num) for end in self.ends]
        self.spare = [2 + d // 6 for d in self.differ]

    def signatures(self, found: np.ndarray, frequent: np.ndarray) -> np.ndarray:
        """The signatures of an ascending set, in its own class and the next."""
        n, often, out = len(found), frequent[slot(found)], []
        if n <= SMALL * self.den // self.num:
            first = np.argsort(often, kind="stable")[: n - -(-self.num * n // self.den) + 1]
            out.append(mix(found[first] ^ np.uint64(1 << 62)))
        if n <= SMALL:
            return out[0]
        own, rare = bisect_left(self.ends, n), found[~often]
        for c in (own, own + 1):
            if self._parts(rare, c, False, out) > self.spare[c]:
                self._parts(found, c, True, out)
        return np.concatenate(out)

    def _parts(self, some: np.ndarray, c: int, whole: bool, out: list[np.ndarray]) -> int:
        """Adds the signatures of a set's parts, of the last that suffice; returns how many are empty. If those of a whole set are too many, they count, too."""
        parts = self.differ[c] + 1 + self.spare[c]
        # low bits, as the slots of the count are the high ones
        part = ((some & np.uint64(0xFFFFFFFF)) * np.uint64(parts)) >> np.uint64(32)
        order = np.argsort(part, kind="stable")
        part, mixed = part[order], mix(some)[order]
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])[: len(part)])
        sums = np.add.reduceat(mixed, starts) if len(starts) else np.zeros(0, np.uint64)
        place, empty = part[starts], parts - len(starts)
        if empty <= self.spare[c]:
            sums, place = sums[-self.differ[c] - 1 :], place[-self.differ[c] - 1 :]
        elif whole:
            more = np.setdiff1d(np.arange(parts, dtype=np.uint64), place)
            sums, place = np.concatenate([sums, np.zeros(empty, np.uint64)]), np.concatenate([place, more])
        out.append(mix(sums ^ mix(place + np.uint64((2 * c + whole) << 40 | 1 << 39))))
        return empty


def packed(posts: np.ndarray) -> np.ndarray:
    """A row of bytes for each posting: the upper ones of its signature, then the name."""
    raw = np.ascontiguousarray(posts).view(np.uint8).reshape(-1, POSTING.itemsize)
    return raw[:, 8 - SIGN :]


def unpacked(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The signatures, as far as they were sent, and the names of packed postings."""
    raw = np.frombuffer(b"".join(blocks), np.uint8).reshape(-1, SIGN + 8)
    posts = np.zeros((len(raw), POSTING.itemsize), np.uint8)
    posts[:, 8 - SIGN :] = raw
    posts = posts.view(POSTING).reshape(-1)
    return posts["sign"], posts["name"]


def list_edges(sign: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct edges from the lists of nodes with equal signatures: all pairs of a short list, a star for a long one.

    The pairs are to be looked at again; the stars hold as they are.
    """
    order = np.lexsort((node, sign))
    node, sign = node[order], sign[order]
    starts = np.flatnonzero(np.concatenate([[True], sign[1:] != sign[:-1]]))
    sizes = np.diff(np.append(starts, len(sign)))
    of = np.repeat(np.arange(len(starts)), sizes)
    long = (sizes > PAIRWISE)[of]
    pairs = [np.zeros((0, 2), np.int64)]
    for step in range(1, PAIRWISE):
        at = np.flatnonzero((of[step:] == of[:-step]) & ~long[step:]) if step < len(of) else []
        if not len(at):
            break
        pairs.append(np.stack([node[at], node[at + step]], axis=1))
    star = np.stack([node[starts[of]], node], axis=1)[long]
    clean = lambda e: np.unique(e[e[:, 0] != e[:, 1]], axis=0)
    return clean(np.concatenate(pairs)), clean(star)


def shared_edges(docs: DataFrame, total: int, signatures: Callable[[list[str]], Iterator[tuple[bytes, np.ndarray]]]) -> DataFrame:
    """Edges (a, b, sure) between first halves of names that connect nodes with a signature in common. signatures: texts -> (node, its signatures); total: shingles in all."""
    tasks = store.buckets(docs.sparkSession, total, 4 * DEALT)
    buckets = 4 * tasks

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            posts = np.concatenate(held)
            order = np.lexsort((posts["name"], posts["sign"]))
            posts = posts[order]
            posts = posts[np.concatenate([[True], posts[1:] != posts[:-1]])]  # copies of a document count once
            to = (posts["sign"] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            found, at = np.unique(to[order], return_index=True)
            blocks = [x.tobytes() for x in np.split(packed(posts[order]), at[1:])]
            return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(blocks, pa.binary())], ["bucket", "block"])

        for batch in store.slices(batches):
            for _, texts in _texts(batch, 0):
                for node, signs in signatures(texts):
                    posts = np.empty(len(signs), POSTING)
                    posts["sign"] = signs
                    posts["name"] = np.frombuffer(node, "<u8")[0]
                    held.append(posts)
                    size += len(posts)
                if size > 1 << 18:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def join(part: pa.Table) -> pa.Table:
        signs, names = unpacked(part.column("block").to_pylist())
        own, place = np.unique(names, return_inverse=True)
        pairs, star = list_edges(signs, place)
        both = np.concatenate([pairs, star])
        names = pa.Array.from_buffers(pa.binary(8), len(own), [None, pa.py_buffer(own.tobytes())]).cast(pa.binary())
        return pa.table({"a": names.take(pa.array(both[:, 0])), "b": names.take(pa.array(both[:, 1])), "sure": np.arange(len(both)) >= len(pairs)})

    return store.by_bucket(docs.select("text").mapInArrow(deal, "bucket long, block binary"), "bucket", tasks, join, "a binary, b binary, sure boolean")


def half(node: str | Column = "node") -> Column:
    """The first half of a node's name."""
    return F.substring(node, 1, 8)


def likely_edges(edges: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (a, b) without the pairs whose sketches show that they can't link."""
    edges = store.table(edges.distinct(), "pairs")
    unsure = edges.filter("not sure").select("a", "b")
    own = nodes.filter("n > 0").groupBy("node").agg(F.max("n").alias("n"), F.max("sketch").alias("s"))
    side = lambda x: own.select(half().alias(x), F.col("n").alias(f"n{x}"), F.col("s").alias(f"s{x}"))
    near = (F.col("na") * den >= F.col("nb") * num) & (F.col("nb") * den >= F.col("na") * num)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [np.frombuffer(b"".join(batch.column(x).to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16) for x in ("sa", "sb")]
            total = np.asarray(batch.column("na")) + np.asarray(batch.column("nb"))
            fine = np.abs(s[0] - s[1]).sum(axis=1) * (den + num) <= total * (den - num)
            yield batch.select(["a", "b"]).filter(pa.array(fine))

    def likely(some: Callable[[DataFrame], DataFrame]) -> DataFrame:
        pairs = some(unsure).join(some(side("a")), "a").join(side("b"), "b").filter(near)
        return pairs.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a binary, b binary")

    return edges.filter("sure").select("a", "b").unionAll(in_rounds(likely, -(-unsure.count() // (PAIRS * nodes.count() + 1)), "a", name="likely"))


def in_rounds(work: Callable[[Callable[[DataFrame], DataFrame]], DataFrame], rounds: int, *keys: str, name: str) -> DataFrame:
    """All that ``work`` gives in so many rounds, each with the rows of some keys; their results are written, and a round's shuffle files deleted before the next."""
    if rounds < 2:
        return work(lambda df: df)
    found = [store.table(work(lambda df, r=r: df.filter(F.pmod(F.xxhash64(*keys), F.lit(rounds)) == r)), name) for r in range(rounds)]
    return functools.reduce(DataFrame.unionAll, found)


def candidate_edges(docs: DataFrame, total: int, frequent: np.ndarray, k: int, num: int, den: int) -> DataFrame:
    """Edges (a, b) between nodes such that linked nodes are connected."""
    classes = Classes(num, den)
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(frequent))  # a bit for each slot

    def signatures(texts: list[str]) -> Iterator[tuple[bytes, np.ndarray]]:
        often = np.unpackbits(shared.value).astype(bool)
        for words in word_hashes(texts):
            if len(own := shingle_set(words, k)):
                yield set_key(own), classes.signatures(own, often)

    return shared_edges(docs, total, signatures)


def joined(sets: list[np.ndarray], num: int, den: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each set i of an ascending list by size: (i, later sets j it may link with, |i & j|)."""
    m = len(sets)
    n = np.array([len(s) for s in sets])
    tokens, codes = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), n)
    order = np.argsort(codes, kind="stable")
    lists = owner[order]
    places = codes[order] * m + lists  # ascending: by shingle, then by set
    own = np.split(codes, np.cumsum(n)[:-1])
    stop = np.searchsorted(n, n * den // num, "right")

    def count(some: np.ndarray, low: int, high: int) -> np.ndarray:
        """How often sets low to high - 1 are in the lists of some shingles; the lists' other blocks are jumped over."""
        if not len(some) or low >= high:
            return np.zeros(max(0, high - low), np.int64)
        a, b = np.searchsorted(places, some * m + low), np.searchsorted(places, some * m + high)
        lengths = b - a
        at = np.repeat(a - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        return np.bincount(lists[at] - low, minlength=high - low)

    done: list[tuple[int, int, np.ndarray]] = []
    for i in range(m):
        low, high = i + 1, int(stop[i])
        found = None
        for j, top, known in reversed(done):
            # known[x] is |j & (j + 1 + x)|; i is one of these
            if i < top and den * known[i - j - 1] >= num * len(own[i]):
                more = np.setdiff1d(own[i], own[j], assume_unique=True)
                less = np.setdiff1d(own[j], own[i], assume_unique=True)
                both = min(top, high)
                found = np.concatenate([known[low - j - 1 : both - j - 1] + count(more, low, both) - count(less, low, both), count(own[i], max(low, both), high)])
                break
        if found is None:
            found = count(own[i], low, high)
            done = [*done[-7:], (i, high, found)]
        yield i, np.arange(low, max(low, high)), found


def link_roots(sets: list[np.ndarray], side: np.ndarray | None, num: int, den: int) -> np.ndarray:
    """The first member of each set's component; with ``side``, only links between the two sides count."""
    m = len(sets)
    root = list(range(m))
    n = np.array([len(s) for s in sets])

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, others, both in joined(sets, num, den):
        linked = den * both >= num * (n[i] + n[others] - both)
        if side is not None:
            linked &= side[others] != side[i]
        for j in others[linked].tolist():
            a, b = top(i), top(j)
            if a != b:
                root[max(a, b)] = min(a, b)
    return np.array([top(i) for i in range(m)])


def blocks_of(total: Column) -> Column:
    """The number of blocks for a cluster of so many shingles."""
    return F.greatest(F.least(F.ceil(total / BLOCK), F.lit(BLOCKS)), F.ceil(total / CLUSTER))


def verified_links(docs: DataFrame, members: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Edges (a, b) that connect just the linked nodes; members: (doc_id, twin, node, n, cluster), a row for each node."""
    totals = members.groupBy("cluster").agg(blocks_of(F.sum("n")).alias("blocks"))
    placed = members.join(totals, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    # by id and text, so that rows that share an id meet their own node alone; a null id counts as 0
    ids = placed.select(F.coalesce("doc_id", F.lit(0)).alias("id"), "twin", "node", "cluster", "blocks", "block")
    size = placed.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("n") * F.col("blocks")), F.lit(0)).alias("sent")).first()
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), twin(), "text")
    texts = texts.join(F.broadcast(ids) if size["rows"] <= SEND else ids, ["id", "twin"])
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1), lambda x: F.struct(F.least(x, F.col("block").cast("int")).alias("i"), F.greatest(x, F.col("block").cast("int")).alias("j")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for at, texts in _texts(batch, 4):
                sets = [shingle_set(w, k) for w in word_hashes(texts)]
                fine = []
                for s, node in zip(sets, batch.column(0).slice(at, len(texts)).to_pylist(), strict=True):
                    fine.append(node not in seen and set_key(s) == node)
                    if fine[-1]:
                        seen.add(node)
                if len(seen) > 100_000:  # only spares work: copies meet again in the join
                    seen.clear()
                part = pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, len(texts)) for i in range(4)), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "cluster", "blocks", "block", "tokens"])
                yield part.filter(pa.array(fine))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = {}, None

        def flush() -> pa.RecordBatch:
            nodes = sorted(held, key=lambda x: len(held[x][1]))
            blocks = np.array([held[x][0] for x in nodes])
            roots = link_roots([held[x][1] for x in nodes], None if key[1] == key[2] else blocks, num, den)
            return pa.RecordBatch.from_arrays([pa.array([nodes[r] for r in roots.tolist()], pa.binary()), pa.array(nodes, pa.binary())], ["a", "b"])

        for batch in batches:
            for cluster, i, j, node, block, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (cluster, i, j) != key:
                    if len(held) > 1:
                        yield flush()
                    held, key = {}, (cluster, i, j)
                held[node] = (block, np.frombuffer(tokens, "<u8"))
        if len(held) > 1:
            yield flush()

    sets = texts.select("node", "cluster", "blocks", "block", "text").mapInArrow(pack, "node binary, cluster binary, blocks long, block long, tokens binary")
    rounds = -(-size["sent"] // (BLOCKS * size["n"] + 1))
    sets = store.table(sets, "sets") if rounds > 1 else sets
    n = store.buckets(docs.sparkSession, BLOCKS * size["n"], 4 * CLUSTER)

    def links(some: Callable[[DataFrame], DataFrame]) -> DataFrame:
        keyed = some(sets.withColumn("pair", F.explode(pairs)).select("cluster", "pair.i", "pair.j", "node", "block", "tokens"))
        return keyed.repartition(n, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "node").mapInArrow(join, "a binary, b binary").filter("a <> b")

    return in_rounds(links, rounds, "cluster", "i", "j", name="links")


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest id that links reach from each document."""
    found = linked(docs, k, num, den)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def linked(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, twin, n, component_id, keep of each row (see ``by_component``), by candidates from parts of sets."""
    nodes, frequent = describe(docs, k)
    return by_component(docs, nodes, lambda total: candidate_edges(docs, total, frequent, k, num, den), k, num, den)


def by_component(docs: DataFrame, nodes: DataFrame, candidates: Callable[[int], DataFrame], k: int, num: int, den: int) -> DataFrame:
    """Verify the links between candidates and give each row its component. candidates: all shingles' number -> edges.

    ``keep`` marks the row of the smallest id in each component, and rows without shingles.
    """
    with store.Scope(docs.sparkSession) as scope:
        full = nodes.filter("n > 0")
        total = full.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        clusters = components(likely_edges(candidates(total), nodes, num, den))
        # a node of many copies is one row until the last join, which is a plain one that can be split
        own = full.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "twin")).alias("own"), F.max("n").alias("n"))
        named = clusters.select(F.col("node").alias("half"), F.col("root").alias("cluster"))
        of = own.join(named, half() == F.col("half")).select("own.doc_id", "own.twin", "node", "n", "cluster")
        roots = components(verified_links(docs, store.table(of, "members"), k, num, den))
        rooted = own.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        least = rooted.groupBy("root").agg(F.min("own").alias("least"))
        by_node = scope.keep(rooted.join(least, "root").select("node", "least"), "components")
    some = F.col("n") > 0
    return nodes.join(by_node, "node", "left").select(
        "doc_id",
        "twin",
        "n",
        F.when(some, F.col("least.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(some, F.col("least.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("least.twin") == F.col("twin"))).otherwise(True).alias("keep"),
    )


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, one of each group of linked documents: that of the smallest id.

    Rows that share that id and text are one document, and of these the one stays that comes first by
    all its columns, as text. Rows without words all stay.
    """
    with store.Scope(docs.sparkSession) as scope:
        found = store.table(linked(docs, k, num, den), "kept")
        named = lambda df: df.select(F.col("doc_id").alias("gone_id"), F.col("twin").alias("gone_twin"))
        gone = scope.keep(named(found.filter(~F.col("keep"))).distinct(), "gone")
        again = scope.keep(named(found.filter("keep and n > 0").groupBy("doc_id", "twin").count().filter("count > 1")), "again")
    same = F.col("gone_id").eqNullSafe(F.col("doc_id").cast("long")) & (F.col("gone_twin") == F.xxhash64(F.coalesce("text", F.lit(""))))
    sent = lambda df: F.broadcast(df) if df.count() <= SEND else df
    kept = docs.join(sent(gone), same, "left_anti")
    if again.isEmpty():
        return kept
    columns = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    twice = kept.join(sent(again), same, "left_semi")
    first = twice.groupBy(F.col("doc_id").alias("key"), F.col("text").alias("of")).agg(F.min_by(columns, F.to_json(columns)).alias("one"))
    one = first.select(*[F.col(f"one.c{i}").alias(c) for i, c in enumerate(docs.columns)])
    return kept.join(sent(again), same, "left_anti").unionByName(one)
