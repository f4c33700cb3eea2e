"""Operator 7: document fingerprints by MinHash.

Every shingle (five words, or the whole of a shorter text) goes through a fixed family of
universal hash permutations x -> (a x + b) / 2**32, and a document keeps each one's minimum. A
fingerprint is the hexadecimal string of all minima, 16 bits each; the share of equal minima
estimates the Jaccard similarity. ``minhash_near_duplicates`` joins bands of the minima in
Spark and verifies the Jaccard similarity on whole sets.

Results for odd input: a null text counts as empty; texts without words share one fingerprint
of their own, and are like each other (1) and unlike all others (0); rows with the same id are
ordered by a hash of their text, and null ids come last; texts of any length are read whole, two or
three of them at a time; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm import jaccard, store
from proofline.llm.shingles import mix, set_key, shingle_hashes, shingle_set, word_hashes

PERMUTATIONS = 128
WORDS = 5
_rng = np.random.default_rng(77)
_a = _rng.integers(0, 1 << 63, 1024, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_b = _rng.integers(0, 1 << 63, 1024, dtype=np.uint64)
#: What stands for a minimum over nothing, and for no other.
EMPTY = 0xFFFF


def signatures(texts: list[str | None], permutations: int = PERMUTATIONS, words: int = WORDS) -> np.ndarray:
    """A row of minima (unsigned 16-bit) for each text."""
    out = np.full((len(texts), permutations), EMPTY, np.uint16)
    at, n = 0, len(texts)
    hashes = word_hashes(texts)
    while at < n:
        rows, found, size = [], [], 0
        while at < n and (not found or size + len(hashes[at]) <= 1 << 16):
            own = shingle_hashes(hashes[at], words)
            if len(own):
                rows.append(at)
                found.append(own)
                size += len(own)
            at += 1
        if not found:
            continue
        x = np.concatenate(found) >> np.uint64(32)
        starts = np.concatenate([[0], np.cumsum([len(f) for f in found])[:-1]])
        h = np.empty_like(x)
        for i in range(permutations):
            np.multiply(x, _a[i], out=h)
            h += _b[i]
            out[rows, i] = np.minimum((np.minimum.reduceat(h, starts) >> np.uint64(36)).astype(np.uint16), EMPTY - 1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal minima."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of another text."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows of ``doc_id``, ``text``, ``key``, ``tie``, ``range_no``, ``guest`` such that each range, in descending order of
    ids, is followed by a guest: the first document of the next range, or of all for the last one; and how many ranges there are.

    Only ids and hashes are read to find the guests; one of each for each range reaches the driver.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = docs.withColumn("key", F.col("doc_id")).withColumn("tie", F.xxhash64(F.coalesce("text", F.lit(""))))
    points = store.split_points(docs, "doc_id", store.partitions(docs.sparkSession))
    marked = docs.withColumn("range_no", store.range_no("key", points))
    heads = {r: (head["key"], head["tie"]) for r, head in marked.groupBy("range_no").agg(F.max(F.struct("key", "tie"))).collect()}
    found = sorted(heads, reverse=True)
    if not found:
        return marked.withColumn("guest", F.lit(False)), 1
    after = dict(zip(found, found[1:] + found[:1], strict=True))
    hosts = docs.sparkSession.createDataFrame([(*heads[after[r]], r) for r in found], "of long, of_tie long, host int")
    mine = F.col("key").eqNullSafe(F.col("of")) & (F.col("tie") == F.col("of_tie"))
    marked = marked.join(F.broadcast(hosts), mine, "left")  # a row for each range
    both = F.array(F.struct(F.col("range_no").alias("range_no"), F.lit(False).alias("guest")), F.struct(F.col("host").alias("range_no"), F.lit(True).alias("guest")))
    marked = marked.withColumn("at", F.explode(F.filter(both, lambda x: x["range_no"].isNotNull())))
    return marked.select("doc_id", "text", "key", "tie", "at.range_no", "at.guest"), len(points) + 1


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, permutations: int = PERMUTATIONS, words: int = WORDS) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next document's are."""

    def batch_of(texts: list[str], ids: list, own: int) -> pa.RecordBatch:
        """The first ``own`` of the texts; the last one is only there to follow."""
        after = texts[1 : own + 1]
        changed = [edited(t, f) for t, f in zip(texts[:own], after, strict=True)]
        sig, sig_edited = signatures(texts, permutations, words), signatures(changed, permutations, words)
        name = lambda s: s.astype(">u2").tobytes().hex()
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids[:own], pa.int64()),
                pa.array([len(t) for t in texts[:own]], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                pa.array(map(name, sig[:own])),
                pa.array(map(name, sig_edited)),
                pa.array([likeness(sig[i], sig_edited[i]) for i in range(own)], pa.float64()),
                pa.array([likeness(sig[i], sig[i + 1]) for i in range(own)], pa.float64()),
            ],
            [x.split()[0] for x in OUT.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, ids, size, place, closed = [], [], 0, None, False
        for batch in store.slices(batches):
            for doc, text, here, guest in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if here != place:
                    if len(texts) > 1:
                        yield batch_of(texts, ids, len(texts) - 1)
                    texts, ids, size, place, closed = [], [], 0, here, False
                if closed:  # another row with the guest's id
                    continue
                closed = guest
                texts.append(text or "")
                ids.append(doc)
                size += len(texts[-1])
                if len(texts) > 1 and (size > 1 << 20 or guest):
                    yield batch_of(texts, ids, len(texts) - 1)
                    texts, ids, size = texts[-1:], ids[-1:], 0
        if len(texts) > 1:
            yield batch_of(texts, ids, len(texts) - 1)

    rows, n = with_next(docs)
    ordered = rows.repartitionById(n, "range_no").sortWithinPartitions("range_no", "guest", F.col("key").desc_nulls_last(), F.desc("tie"), "text")
    return ordered.select("doc_id", "text", "range_no", "guest").mapInArrow(run, OUT)


def minhash_near_duplicates(docs: DataFrame, words: int = WORDS, num: int = 80, den: int = 100, band: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id: documents joined by equal bands of minima whose Jaccard similarity is verified.

    Bands of ``band`` minima: at the default similarity of 0.8, a pair misses all 32 with a chance
    below one in ten million. Equal bands give stars, not pairs, and whole sets are compared.
    """

    def bands(texts: list[str]) -> Iterator[tuple[bytes, np.ndarray]]:
        sig = signatures(texts, PERMUTATIONS, words).astype(np.uint64).reshape(len(texts), -1, band)
        names = np.zeros(sig.shape[:2], np.uint64) + np.arange(sig.shape[1], dtype=np.uint64)
        for i in range(band):
            names = mix(names << np.uint64(16) ^ sig[:, :, i] ^ names >> np.uint64(48))
        for own, hashes in zip(names, word_hashes(texts), strict=True):
            if len(found := shingle_set(hashes, words)):
                yield set_key(found), own

    nodes, _ = jaccard.describe(docs, words)
    found = jaccard.by_component(docs, nodes, lambda total: jaccard.shared_edges(docs, total, bands), words, num, den)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
