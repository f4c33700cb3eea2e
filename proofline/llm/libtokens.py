"""Token ids by the tokenizers library, piece by piece with a bounded memo.

The library's own split runs as a regular expression here and each new piece goes to the
library's model once for each worker; texts with unusual characters or special tokens go to it whole.
"""

from __future__ import annotations

import os
from array import array

from proofline.llm import store
from proofline.llm.wordsplit import PieceEncoder, Splitter, byte_alphabet

#: Words in each of the two generations of a worker's memo.
MEMO = 500_000


class LibraryTokenizer:
    """Whole texts -> ids as little-endian unsigned 32-bit bytes, without special tokens added."""

    def __init__(self, path: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.splitter = Splitter(path)
        self.splitter.model = None  # the library has it; read as Python objects it takes 15 MB
        self.model = self.library.model
        self.alphabet = {b: ord(c) for b, c in byte_alphabet().items()}
        self.memo = PieceEncoder(self.splitter, self.piece, memo)

    def piece(self, piece: str) -> bytes:
        """One piece by the library's model, without its normaliser and split, which are done."""
        if piece.isascii() and piece[1:].isalpha():
            symbols = piece if piece[0] != " " else "\u0120" + piece[1:]
        else:
            symbols = piece.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.model.tokenize(symbols)]).tobytes()

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.splitter.kind and self.splitter.plain(text):
            return self.memo.plain(text)
        return self.whole(text)


_ready: dict[tuple[str, int], LibraryTokenizer] = {}


def ready(path: str, memo: int = MEMO) -> LibraryTokenizer:
    """One tokenizer for each worker process and file, with its memo of twice ``memo`` words."""
    if (path, memo) not in _ready:
        _ready[path, memo] = LibraryTokenizer(path, memo)
        store.release()  # what reading the file took
    return _ready[path, memo]


def forget() -> None:
    """Gives up this worker's tokenizers and memos, where a later step needs none."""
    if _ready:
        _ready.clear()
        store.release()
