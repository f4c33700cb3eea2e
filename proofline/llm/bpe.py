"""Operator 1: BPE encoding and decoding with a segment tree over adjacent pair ranks.

A piece's symbols stand in a row; leaf i of the tree holds the merge rank of the pair that
starts at symbol i, packed above i itself. The root is then the leftmost pair of the lowest
rank. A merge changes at most three leaves, each in logarithmic time, until the root says
that no pair can be merged. Pieces repeat, so each worker keeps a bounded memo of them.

Texts are cut into pieces by the file's pattern. Where a text holds characters on which Unicode tables
may differ, the tokenizers library's own normaliser and splitter cut it, so that its pieces are the
library's for every code point; merging is always the tree's.

Results for odd input: a null or empty text has no ids and decodes to the empty string;
repeated rows give repeated results; no length is limited; an empty table gives no rows. Columns of the input
other than ``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from proofline.llm import store
from proofline.llm.wordsplit import Memo, PieceEncoder, Splitter, byte_alphabet

#: Words in each of the two generations of a worker's memo.
MEMO = 300_000
NONE = 1 << 62
SHIFT = 32


class SegmentTreeBPE:
    """Encoder and decoder for a tokenizer file with a BPE model over byte symbols."""

    def __init__(self, path: str, memo: int = MEMO):
        self.splitter = Splitter(path)
        if self.splitter.kind is None:
            raise ValueError(f"{path} is neither a byte-level nor a word-end BPE file")
        model = self.splitter.model
        vocab = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        alphabet = byte_alphabet()
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        #: (left id, right id) packed -> (rank, merged id) packed
        self.merge = {vocab[a] << SHIFT | vocab[b]: rank << SHIFT | vocab[a + b] for rank, (a, b) in enumerate(pairs)}
        self.first = [vocab[alphabet[b]] for b in range(256)]
        self.last = [vocab[alphabet[b] + self.end] for b in range(256)]
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.splitter.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        back = {c: b for b, c in alphabet.items()}
        self.decoder = self.splitter.kind == "byte"
        self.raw = [bytes(map(back.get, t)) if i not in self.splitter.special.values() and all(c in back for c in t) else t.encode() for i, t in enumerate(self.names)] if self.decoder else []
        self.memo = PieceEncoder(self.splitter, lambda piece: self.encode_piece(piece.encode()), memo)
        library = Tokenizer.from_file(path)
        self.normaliser, self.cutter = library.normalizer, library.pre_tokenizer
        self.symbols = {ord(c): b for c, b in back.items()}
        #: pieces as the library spells them, in the byte alphabet
        self.spelt = Memo(lambda piece: self.encode_piece(piece.translate(self.symbols).encode("latin-1")), memo // 2)

    def encode_unusual(self, text: str) -> bytes:
        """The ids of a text without special tokens, cut by the library's normaliser and splitter."""
        text = text if self.normaliser is None else self.normaliser.normalize_str(text)
        return b"".join([self.spelt[piece] for piece, _ in self.cutter.pre_tokenize_str(text)])

    def encode_piece(self, data: bytes) -> bytes:
        """Merge one piece's bytes with the segment tree."""
        ids = [self.first[b] for b in data]
        ids[-1] = self.last[data[-1]]
        n, merge = len(ids), self.merge
        if n > 1:
            width = 1 << (n - 1).bit_length()
            tree = [NONE] * (2 * width)
            for i in range(n - 1):
                found = merge.get(ids[i] << SHIFT | ids[i + 1])
                if found is not None:
                    tree[width + i] = found >> SHIFT << SHIFT | i
            for k in range(width - 1, 0, -1):
                a, b = tree[2 * k], tree[2 * k + 1]
                tree[k] = a if a < b else b
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            while (best := tree[1]) != NONE:
                i = best & 0xFFFFFFFF
                j = after[i]
                ids[i] = merge[ids[i] << SHIFT | ids[j]] & 0xFFFFFFFF
                ids[j] = -1
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    found = merge.get(ids[i] << SHIFT | ids[k])
                else:
                    found = None
                changed = [(i, NONE if found is None else found >> SHIFT << SHIFT | i)]
                if tree[width + j] != NONE:
                    changed.append((j, NONE))
                h = before[i]
                if h >= 0:
                    found = merge.get(ids[h] << SHIFT | ids[i])
                    changed.append((h, NONE if found is None else found >> SHIFT << SHIFT | h))
                for at, value in changed:
                    at += width
                    tree[at] = value
                    while at > 1:
                        other = tree[at ^ 1]
                        if other < value:
                            value = other
                        at >>= 1
                        if tree[at] == value:
                            break
                        tree[at] = value
            ids = [x for x in ids if x >= 0]
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.splitter.plain(text):
            return self.memo.plain(text)
        return b"".join(np.array([i], "<u4").tobytes() if i is not None else self.encode_unusual(part) for i, part in self.splitter.parts(text))

    def decode(self, ids: bytes) -> str:
        """The text of ids. Byte-level files join bytes; files without a decoder join symbols by spaces."""
        table = self.raw if self.decoder else self.names
        got = map(table.__getitem__, np.frombuffer(ids, "<u4").tolist())
        return b"".join(got).decode("utf-8", "replace") if self.decoder else " ".join(got)


_ready: dict[str, SegmentTreeBPE] = {}


def ready(path: str) -> SegmentTreeBPE:
    """One encoder for each worker process and file, with its memo."""
    if path not in _ready:
        _ready[path] = SegmentTreeBPE(path)
    return _ready[path]


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit) and ``decoded`` of each row, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ready(path)
        for batch in store.slices(batches):
            ids = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())],
                [key, "n_tokens", "ids", "decoded"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids binary, decoded string")


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """The digest of ``encode_documents``: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Encoding, decoding and hashing happen batch by batch in one pass, so that ids and
    decoded texts never travel back to the JVM.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ready(path)
        for batch in store.slices(batches):
            counts, of_ids, of_text = [], [], []
            for t in batch.column(1).to_pylist():
                ids = bpe.encode(t)
                counts.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
