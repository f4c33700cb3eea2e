"""Operator 3: removal of repeated passages by a run-length index, shard by shard.

A byte goes when a string of ``least`` bytes that covers it also starts earlier: in a document
with a smaller id or earlier in the same one. Strings are judged on the input.

One index over a corpus fits no machine, so strings that may be equal are brought together first:

1. Each string of ``least`` bytes is assigned to the anchor in it: its leftmost K-byte piece of
   the lowest hash. Equal strings have equal anchors at equal places. The strings of one
   occurrence of an anchor are neighbours and form a segment; a mark (a hash of its content) says
   which segments may be equal, and no more than that. Segments that look alike within a block of a task's
   input are settled there, so a passage that a third of all documents share goes on once for each
   block, not once for each document. The rest are dealt out by anchor, as numbers only.
2. Anchors with several segments need their bytes: these are cut from the texts and dealt out by
   anchor. What many segments share an anchor by (a common line, say) is first cut into segments of
   fewer strings, dealt out by all bytes that those strings have in common, so that no shard grows with
   the number of documents in which a short passage stands; if an anchor's segments still are too large for
   one index, they are taken apart into single strings in place.
3. In a block or a shard, a run-compressed Burrows-Wheeler index with samples at run ends is built over the
   earliest segment of each mark. All other segments are streamed against it: where one agrees with the
   index over its whole length, all its strings are repeats. Streaming the index's own strings gives
   matching statistics, by which matches of at least ``least`` bytes make equal strings classes; all
   strings of a class but the earliest are repeats. So every byte that goes was matched in an index.
4. The marked spans go back to their documents.

Texts cross the network compressed, twice; everything else is numbers in packed blocks, and the bytes of
segments whose anchor is there more than once. Buckets are as many as the input's bytes ask for.

Results for odd input: null and empty texts have no bytes; texts shorter than ``least`` lose
nothing; long texts are worked on block by block; rows that repeat both id and text count as one document and get the same result; rows
that repeat an id with another text are documents of their own, ordered by the text's hash; null
ids come before all others; an empty table gives no rows; other columns pass through
``remove_repeats`` whatever their names, except the four that it adds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm import store
from proofline.llm.rindex import RunIndex, classes
from proofline.llm.shingles import BLOCK, mix

K = 32
LEAST = 100
NO_ID = -(1 << 63)
#: Bytes of text in a block of a task's input, and for each bucket.
HELD, DEALT = 8 << 20, 8 << 20
#: Bytes of segments in one run-length index.
SHARD = 1 << 19
#: Strings in a segment, by how many segments share the anchor: all, from the first number on 8, from the second on 1.
#: They divide the work and no more: an anchor has one width everywhere, and ``cut`` brings equal strings together at each.
MANY, WIDTHS = (1_000, 100_000), (1 << 15, 8, 1)
_rng = np.random.default_rng(31)
_odd = lambda n: _rng.integers(1, 1 << 63, n, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
VALUE, BASE = _odd(256), int(_odd(1)[0])
_inverse = pow(BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []
#: doc and twin name the document, at is the anchor, low and high are its distances from the last and first string's start.
ANCHOR = np.dtype([("anchor", "<u8"), ("doc", "<i8"), ("twin", "<i8"), ("at", "<i8"), ("low", "<u2"), ("high", "<u2"), ("mark", "<u8")])
#: A segment that is wanted, and how many strings may be in one piece of it.
WANT = np.dtype([*ANCHOR.descr, ("width", "<u2")])
SPAN = np.dtype([("doc", "<i8"), ("twin", "<i8"), ("first", "<i8"), ("last", "<i8")])


def pack(rows: np.ndarray) -> bytes:
    """A structured array as one block, column after column, which compresses better than row after row."""
    return len(rows).to_bytes(8, "little") + b"".join(np.ascontiguousarray(rows[f]).tobytes() for f in rows.dtype.names)


def unpack(blocks: list[bytes], kind: np.dtype) -> np.ndarray:
    """The rows of packed blocks."""
    out = []
    for block in blocks:
        n, at = int.from_bytes(block[:8], "little"), 8
        rows = np.empty(n, kind)
        for f in kind.names:
            rows[f] = np.frombuffer(block, kind[f], n, at)
            at += n * kind[f].itemsize
        out.append(rows)
    return np.concatenate(out) if out else np.empty(0, kind)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i for i < n, modulo 2 ** 64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + 1)
        up, down = np.full(size, BASE, np.uint64), np.full(size, _inverse, np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _powers[0], _powers[1]


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """For each window, the place of its lowest hash (by 32 bits); the leftmost of equal ones."""
    least = h & np.uint64(0xFFFFFFFF00000000) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        rest = width - span
        least = np.minimum(least[: len(least) - rest], least[rest:])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def anchors(data: bytes, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """(anchor hash, place, low, high, content mark) of each segment of a text, block by block."""
    step = BLOCK - least + 1
    parts = [_anchors(data[x : x + BLOCK], least, x) for x in range(0, len(data) - least + 1, step)]
    return parts[0] if len(parts) == 1 else tuple(map(np.concatenate, zip(*parts, strict=True)))


def _anchors(data: bytes, least: int, offset: int) -> tuple[np.ndarray, ...]:
    n = len(data)
    raw = VALUE[np.frombuffer(data, np.uint8)]
    h, factor, span = raw, BASE, 1
    while span < K:
        h = h[:-span] * np.uint64(factor) + h[span:]
        factor = factor * factor % (1 << 64)
        span *= 2
    h = mix(h)
    place = sliding_least(h, least - K + 1)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.append(first[1:], len(place)) - 1
    at = place[first]
    up, down = powers(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(raw * up[:n], out=sums[1:])
    mark = mix((sums[last + least] - sums[first]) * down[first])
    return h[at], at + offset, at - last, at - first, mark


def _flat(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple]:
    for batch in store.slices(batches):
        yield from zip(*(batch.column(i).to_pylist() for i in range(columns)), strict=True)


def _spans(rows: np.ndarray, least: int) -> np.ndarray:
    """The bytes that the strings of segments cover."""
    out = np.empty(len(rows), SPAN)
    out["doc"], out["twin"] = rows["doc"], rows["twin"]
    out["first"], out["last"] = rows["at"] - rows["high"], rows["at"] - rows["low"] + least
    return out


def _earliest(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the earliest of the segments of one mark, of the others, and of the earliest that each of these belongs to.

    A segment that is there twice counts once.
    """
    order = np.lexsort((rows["at"], rows["twin"], rows["doc"], rows["mark"], rows["high"], rows["low"], rows["anchor"]))
    rows = rows[order]
    same = np.ones(max(0, len(rows) - 1), bool)
    for f in ("anchor", "low", "high", "mark"):
        same &= rows[f][1:] == rows[f][:-1]
    twice = same.copy()
    for f in ("doc", "twin", "at"):
        twice &= rows[f][1:] == rows[f][:-1]
    first = np.concatenate([[True], ~same])[: len(rows)]
    again = np.concatenate([[False], twice])[: len(rows)]
    rest = ~first & ~again
    return order[first], order[rest], order[first][(np.cumsum(first) - 1)[rest]]


def settle(rows: np.ndarray, body: Callable[[int], bytes], first: np.ndarray, others: np.ndarray, of: np.ndarray, least: int, own: bool, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray]:
    """Spans of repeats among segments, and places of segments whose mark misled. body: place -> bytes.

    The segments at ``first`` make up the indexes, up to ``shard`` bytes or so in each; those at ``others`` are
    streamed, each against its one at ``of``. With ``own``, the former's own strings are compared, too, and an
    index takes whole anchors (``strings`` takes those apart that are too large for one).
    """
    sizes = rows["high"].astype(np.int64) - rows["low"] + least
    total, begin, spans, odd = np.cumsum(sizes[first]), 0, [np.empty(0, SPAN)], [np.zeros(0, np.int64)]
    place = np.empty(len(rows), np.int64)
    place[first] = np.arange(len(first))
    held = place[of]
    order = np.argsort(held, kind="stable")
    others, held = others[order], held[order]
    breaks = np.flatnonzero(np.diff(rows["anchor"][first])) + 1 if own else np.arange(1, len(first))
    for stop in [*breaks.tolist(), len(first)] if len(first) else []:
        if stop < len(first) and total[stop - 1] - (total[begin - 1] if begin else 0) < shard:
            continue
        members = first[begin:stop]
        index = RunIndex([body(i) for i in members.tolist()], least)
        a, b = np.searchsorted(held, (begin, stop))
        for x in range(a, b, 1 << 14):
            some = others[x : min(b, x + (1 << 14))]
            whole = index.follow(held[x : x + len(some)] - begin, [body(i) for i in some.tolist()]) == sizes[some]
            spans.append(_spans(rows[some[whole]], least))
            odd.append(some[~whole])
        if own:
            spans.append(_judge(rows[members], index))
        begin = stop
    return np.concatenate(spans), np.concatenate(odd)


def strings(rows: np.ndarray, body: Callable[[int], bytes], some: np.ndarray, least: int) -> tuple[np.ndarray, list[bytes]]:
    """Some segments taken apart into single strings, each with its own hash as anchor and mark."""
    out, data = [], []
    for i in some.tolist():
        _, doc, twin, at, low, high, _ = rows[i].tolist()
        own = body(i)
        for k in range(high - low + 1):
            data.append(own[k : k + least])
            key = xxhash.xxh3_64_intdigest(data[-1])
            out.append((key, doc, twin, at, high - k, high - k, key))
    return np.array(out, ANCHOR), data


def _judge(rows: np.ndarray, index: RunIndex) -> np.ndarray:
    """Spans of all strings but the earliest of each class of the index's own."""
    least = index.least
    of, at, number = classes(index)
    same = number[1:] == number[:-1]  # classes stand side by side; those of one string have no repeat
    several = np.concatenate([[False], same])[: len(of)] | np.concatenate([same, [False]])[: len(of)]
    of, at, number = of[several], at[several], number[several]
    start = rows["at"][of] - rows["high"][of] + at
    order = np.lexsort((start, rows["twin"][of], rows["doc"][of], number))
    of, start, number = of[order], start[order], number[order]
    doc, twin = rows["doc"][of], rows["twin"][of]
    later = np.concatenate([[False], (number[1:] == number[:-1])])[: len(of)]
    head = np.maximum.accumulate(np.where(later, 0, np.arange(len(of)))) if len(of) else of
    later &= ~((doc == doc[head]) & (twin == twin[head]) & (start == start[head]))
    doc, twin, start = doc[later], twin[later], start[later]
    order = np.lexsort((start, twin, doc))
    doc, twin, start = doc[order], twin[order], start[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (twin[1:] != twin[:-1]) | (start[1:] > start[:-1] + least)])[: len(doc)]
    out = np.empty(int(new.sum()), SPAN)
    ends = np.append(np.flatnonzero(new)[1:], len(doc)) - 1
    out["doc"], out["twin"], out["first"], out["last"] = doc[new], twin[new], start[new], start[ends[: len(out)]] + least
    return out


def _sharing(anchor: np.ndarray) -> np.ndarray:
    """How many of the rows have each one's anchor."""
    _, of, times = np.unique(anchor, return_inverse=True, return_counts=True)
    return times[of]


def _deal(rows: np.ndarray, buckets: int, field: str) -> Iterator[tuple[int, bytes]]:
    """Packed blocks of rows for each bucket of a field."""
    if not len(rows):
        return
    key = rows[field].astype(np.uint64)
    to = (mix(key) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    found, at = np.unique(to[order], return_index=True)
    for bucket, part in zip(found.tolist(), np.split(rows[order], at[1:]), strict=True):
        yield bucket, pack(part)


BLOCKS = "bucket long, kind int, block binary"


def _blocks(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], ["bucket", "kind", "block"])


#: Kinds of blocks.
SEGMENTS, SPANS, WANTED = 0, 1, 2


def find_segments(texts: DataFrame, buckets: int, least: int) -> DataFrame:
    """Blocks of spans and of wanted segments, by the bucket of their document. texts: (doc, twin, text)."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        data: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            rows, of = np.concatenate(held), np.concatenate(owner)
            first, others, member = _earliest(rows)

            def body(i: int) -> bytes:
                row = rows[i]
                at = int(row["at"])
                return data[of[i]][at - int(row["high"]) : at - int(row["low"]) + least]

            copied = np.zeros(len(rows), bool)
            copied[member] = True
            spans, odd = settle(rows, body, first[copied[first]], others, member, least, False)
            out = [(b, SEGMENTS, x) for b, x in _deal(rows[np.sort(np.concatenate([first, odd]))], buckets, "anchor")]
            # spans ride along by the bucket of their document, and are passed on there
            out += [(b, SPANS, x) for b, x in _deal(spans, buckets, "doc")]
            return _blocks(out)

        for doc, twin, text in _flat(batches, 3):
            raw = (text or "").encode("utf-8", "surrogatepass")
            if len(raw) < least:
                continue
            found = anchors(raw, least)
            rows = np.empty(len(found[0]), ANCHOR)
            rows["doc"], rows["twin"] = doc, twin
            for f, x in zip(("anchor", "at", "low", "high", "mark"), found, strict=True):
                rows[f] = x
            held.append(rows)
            owner.append(np.full(len(rows), len(data)))
            data.append(raw)
            size += len(raw)
            if size > HELD:
                yield flush()
                held, owner, data, size = [], [], [], 0
        if held:
            yield flush()

    def group(part: pa.Table) -> pa.Table:
        kinds = np.asarray(part.column("kind"))
        blocks = part.column("block")
        number = part.column("bucket")[0].as_py()
        out = [(number, SPANS, blocks[i].as_py()) for i in np.flatnonzero(kinds == SPANS).tolist()]
        rows = unpack([blocks[i].as_py() for i in np.flatnonzero(kinds == SEGMENTS).tolist()], ANCHOR)
        times = _sharing(rows["anchor"])
        wanted = np.empty(int((times > 1).sum()), WANT)
        for f in ANCHOR.names:
            wanted[f] = rows[f][times > 1]
        wanted["width"] = np.array(WIDTHS)[np.searchsorted(MANY, times[times > 1], "right")]
        out += [(b, WANTED, x) for b, x in _deal(wanted, buckets, "doc")]
        return pa.Table.from_batches([_blocks(out)])

    return store.by_bucket(texts.mapInArrow(look, BLOCKS), "bucket", _tasks(texts, buckets), group, BLOCKS)


def _tasks(df: DataFrame, buckets: int) -> int:
    """Partitions for a shuffle by bucket: four buckets or so in each, no fewer than the session's."""
    return max(store.partitions(df.sparkSession), buckets // 4)


def _beside(texts: DataFrame, blocks: DataFrame, buckets: int, run, schema: str) -> DataFrame:
    """Streams each bucket's blocks and then its texts, compressed, through ``run``."""

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1).compress
        for batch in store.slices(batches):
            docs = np.asarray(batch.column("doc"))
            to = (mix(docs.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            data = [zip_((t or "").encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
            own = [batch.column(x) for x in names[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array([9] * len(to), pa.int32()), pa.array(data, pa.binary()), *own], ["bucket", "kind", "block", *names[1:]])

    names = ["text", *(c for c in texts.columns if c != "text")]
    kinds = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in names[1:])
    packed = texts.select(*names).mapInArrow(squeeze, f"bucket long, kind int, block binary, {kinds}")
    n = _tasks(texts, buckets)
    both = packed.unionByName(blocks, allowMissingColumns=True)
    return store.deal(both, "bucket", n, "kind").mapInArrow(run, schema)


SEGMENT = "shard long, anchor binary, body binary"


def cut(own: np.ndarray, data: bytes, least: int) -> Iterator[tuple[tuple, bytes]]:
    """The wanted segments of a text, whole or in pieces of ``width`` strings: (row, bytes).

    A piece's anchor is a hash of what all strings of its ``width`` distances have in common, whether a text has all of
    them or not; so however short a segment is, its strings meet their equals, cut or not alike for all of an anchor.
    """
    for anchor, doc, twin, at, low, high, mark, width in own.tolist():
        if width == WIDTHS[0]:
            yield (anchor, doc, twin, at, low, high, mark), data[at - high : at - low + least]
            continue
        # pieces end at the same distances from the anchor in every text
        for b in range(high, low - 1, -1):
            if b < high and (b + 1) % width:
                continue
            n = b // width
            a = max(low, n * width)
            body = data[at - b : at - a + least]
            key = xxhash.xxh3_64_intdigest(data[at - n * width : at - (n + 1) * width + 1 + least], anchor ^ n)
            yield (key, doc, twin, at, a, b, xxhash.xxh3_64_intdigest(body)), body


def fetch(texts: DataFrame, wanted: DataFrame, buckets: int, least: int) -> DataFrame:
    """The bytes of wanted segments, in blocks by the bucket of their extended anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor().decompress
        place, held, rows, got, bodies, size = None, [], None, [], [], 0

        def flush() -> pa.RecordBatch:
            found = np.array(got, ANCHOR)
            to = (mix(found["anchor"]) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            shards, at = np.unique(to[order], return_index=True)
            parts = np.split(order, at[1:])
            return pa.RecordBatch.from_arrays(
                [pa.array(shards), pa.array([pack(found[p]) for p in parts], pa.binary()), pa.array([b"".join([bodies[i] for i in p.tolist()]) for p in parts], pa.binary())],
                ["shard", "anchor", "body"],
            )

        for bucket, kind, block, doc, twin in _flat(batches, 5):
            if bucket != place:
                place, held, rows = bucket, [], None
            if kind == WANTED:
                held.append(block)
                continue
            if rows is None:
                rows = unpack(held, WANT)
                rows = rows[np.argsort(rows["doc"], kind="stable")]
            own = rows[np.searchsorted(rows["doc"], doc, "left") : np.searchsorted(rows["doc"], doc, "right")]
            own = own[own["twin"] == twin]
            if len(own):
                for row, body in cut(own, unzip(block), least):
                    got.append(row)
                    bodies.append(body)
                    size += len(body)
                if size > 1 << 22:
                    yield flush()
                    got, bodies, size = [], [], 0
        if got:
            yield flush()

    return _beside(texts.select("doc", "twin", "text"), wanted, buckets, run, SEGMENT)


def index_spans(segments: DataFrame, buckets: int, least: int, shard: int = SHARD) -> DataFrame:
    """Blocks of spans that each shard's run-length indexes give."""

    def group(part: pa.Table) -> pa.Table:
        rows = unpack(part.column("anchor").to_pylist(), ANCHOR)
        ends = np.cumsum(rows["high"].astype(np.int64) - rows["low"] + least)
        begins, data = np.concatenate([[0], ends[:-1]]).tolist(), b"".join(part.column("body").to_pylist())
        ends = ends.tolist()
        body = lambda i: data[begins[i] : ends[i]]
        # the bytes of each anchor's segments of different marks, to find those too large for one index
        first, _, _ = _earliest(rows)
        names, group_of = np.unique(rows["anchor"][first], return_inverse=True)
        total = np.bincount(group_of, rows["high"][first].astype(np.int64) - rows["low"][first] + least)
        large = np.isin(rows["anchor"], names[total > shard])
        spans = [whole(rows, body, np.flatnonzero(~large))]
        if large.any():
            apart, data_of = strings(rows, body, np.flatnonzero(large), least)
            spans.append(whole(apart, data_of.__getitem__, np.arange(len(apart))))
        return pa.Table.from_batches([_blocks([(b, SPANS, x) for b, x in _deal(np.concatenate(spans), buckets, "doc")])])

    def whole(rows: np.ndarray, body: Callable[[int], bytes], some: np.ndarray) -> np.ndarray:
        """Spans of some of the segments."""
        first, others, of = (some[x] for x in _earliest(rows[some]))
        needed = (_sharing(rows["anchor"][first]) > 1) | np.isin(first, of)
        spans, odd = settle(rows, body, first[needed], others, of, least, True, shard)
        if len(odd):  # marks that misled: all segments of such an anchor, once more and each in the index
            again = some[np.isin(rows["anchor"][some], rows["anchor"][odd])]
            again = again[np.argsort(rows["anchor"][again], kind="stable")]
            none = np.zeros(0, np.int64)
            spans = np.concatenate([spans, settle(rows, body, again, none, none, least, True)[0]])
        return spans

    return store.by_bucket(segments, "shard", _tasks(segments, buckets), group, BLOCKS)


def remove_repeats(docs: DataFrame, least: int = LEAST, keep_text: bool = True, shard: int = SHARD) -> DataFrame:
    """All columns of ``docs``, with what is left as ``text``, and n_bytes, n_removed, n_spans, kept_sha256.

    Without ``keep_text`` the text stays behind. Where a removed span cuts a character in two, its
    other bytes go from ``text``, too, but not from ``kept_sha256``.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = 2 * store.buckets(docs.sparkSession, size, 2 * DEALT)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("twin"),
        F.col("text"),
        F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)]).alias("rest"),
    )
    found = store.table(find_segments(texts.select("doc", "twin", "text"), buckets, least), "segments")
    segments = fetch(texts, found.filter(F.col("kind") == WANTED), buckets, least)
    spans = store.table(index_spans(segments, buckets, least, shard), "spans").unionAll(found.filter(F.col("kind") == SPANS))
    names = ["n_bytes", "n_removed", "n_spans"]
    schema = f"doc long, rest {texts.schema['rest'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor().decompress
        place, held, rows = None, [], None
        for batch in store.slices(batches):
            keep, out = [], []
            kinds, blocks = batch.column("kind").to_pylist(), batch.column("block")
            docs_, twins = batch.column("doc").to_pylist(), batch.column("twin").to_pylist()
            for i, bucket in enumerate(batch.column("bucket").to_pylist()):
                if bucket != place:
                    place, held, rows = bucket, [], None
                if kinds[i] == SPANS:
                    held.append(blocks[i].as_py())
                    continue
                if rows is None:
                    rows = unpack(held, SPAN)
                    rows = rows[np.lexsort((rows["first"], rows["doc"]))]
                own = rows[np.searchsorted(rows["doc"], docs_[i], "left") : np.searchsorted(rows["doc"], docs_[i], "right")]
                own = own[own["twin"] == twins[i]]
                data = unzip(blocks[i].as_py())
                kept, removed, runs = data, 0, 0
                if len(own):
                    first, last = own["first"], np.maximum.accumulate(own["last"])
                    new = np.concatenate([[True], first[1:] > last[:-1]])
                    begins, ends = first[new].tolist(), last[np.append(np.flatnonzero(new)[1:], len(own)) - 1].tolist()
                    kept = b"".join(data[x:y] for x, y in zip([0, *ends], [*begins, len(data)], strict=True))
                    removed, runs = len(data) - len(kept), len(begins)
                keep.append(i)
                out.append((len(data), removed, runs, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if keep_text else None))
            own_rows = batch.take(pa.array(keep, pa.int64()))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [own_rows.column("doc"), own_rows.column("rest"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.string())],
                ["doc", "rest", *names, "kept_sha256", "kept"],
            )

    done = _beside(texts, spans, buckets, run, schema)
    back = {c: F.col(f"rest.c{i}").alias(c) for i, c in enumerate(rest) if c not in {*names, "kept_sha256"}}
    back["doc_id"] = F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id")
    back["text"] = F.col("kept").alias("text")
    wanted = [back[c] for c in docs.columns if c in back and (keep_text or c != "text")]
    return done.select(*wanted, *names, "kept_sha256")
