"""How two public tokenizer files cut a text into pieces that are encoded one by one.

The patterns are fixed values: they are part of the tokenizer files' format.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import regex

#: The split patterns of word-end BPE and of byte-level BPE files.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters on which Python's and the tokenizers library's Unicode tables can't differ and
#: which normalisation leaves alone. Anything else takes the slower, general path.
UNUSUAL = re.compile("[^\t\n\r -~\xa1-įı-ɏ‐-‧€]")
#: The ASCII characters among those that are not unusual.
USUAL_ASCII = bytes([0x09, 0x0A, 0x0D, *range(0x20, 0x7F)])


def byte_alphabet() -> dict[int, str]:
    """Byte -> printable character, by the rule of byte-level BPE: printable Latin-1 stays, the rest moves up from 256."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = (b for b in range(256) if b not in set(keep))
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(moved)}


def lower(text: str) -> str:
    """Lower case character by character (no special final sigma)."""
    return text.replace("Σ", "σ").lower()


class Splitter:
    """Text -> pieces, for tokenizer files of the two kinds above; ``kind`` is None for others."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        normal, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.model = spec["model"]
        steps = [x.get("type") for x in normal.get("normalizers", [])]
        splits = [x.get("type") for x in pre.get("pretokenizers", [])]
        self.kind = None
        if not normal and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.kind, self.find = "byte", regex.compile(BYTE_PATTERN).findall
        elif steps == ["NFC", "Replace", "Lowercase"] and splits == ["Split", "ByteLevel"]:
            self.kind, self.find = "word", regex.compile(WORD_PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def plain(self, text: str) -> bool:
        """Whether ``pieces`` needs neither normalisation nor a look for special tokens. Only what is left without usual ASCII is looked at one by one."""
        rest = text.encode("utf-8", "surrogatepass").translate(None, USUAL_ASCII)
        return "<|" not in text and (not rest or UNUSUAL.search(rest.decode("utf-8", "surrogatepass")) is None)

    def parts(self, text: str) -> list[tuple[int | None, str]]:
        """A text cut at special tokens: (id, "") for one of them, (None, text) for what lies between."""
        if self.cut is None or "<|" not in text:
            return [(None, text)]
        return [(self.special[x], "") if x in self.special else (None, x) for x in self.cut.split(text) if x]


#: Keys longer than this are made anew each time, and an entry's bytes beside its key and value.
LONG, ENTRY = 64, 120


class Memo(dict):
    """Key -> what ``make`` gives for it. Of two generations of at most ``size`` keys and 128 times as many bytes, the older is dropped when the newer is full."""

    def __init__(self, make: Callable[[str], bytes], size: int):
        super().__init__()
        self.make, self.size, self.older, self.room = make, size, {}, 128 * size

    def __missing__(self, key: str) -> bytes:
        if len(key) > LONG:
            return self.make(key)
        made = self.older.get(key)
        if made is None:
            made = self.make(key)
        if len(self) >= self.size or self.room < 0:
            self.older, self.room = dict(self), 128 * self.size
            self.clear()
        self.room -= len(key) + len(made) + ENTRY
        self[key] = made
        return made


class PieceEncoder:
    """Whole texts -> ids, by an encoder of single pieces and memos of pieces and of space-bounded words.

    A text is first cut at spaces, which is quicker than the pattern; a word that is new is cut by
    the pattern. Texts in which a piece may span a space are cut by the pattern at once.
    """

    def __init__(self, splitter: Splitter, piece: Callable[[str], bytes], memo: int):
        self.splitter, self.piece = splitter, piece
        self.pieces = Memo(piece, memo // 2)
        self.words = Memo(self.by_word, memo)
        self.spaced = Memo(self.by_spaced, memo)

    def by_pattern(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.splitter.find(text)))

    def by_word(self, word: str) -> bytes:
        """Letters alone are one piece in either pattern."""
        return self.piece(word) if word.isalpha() else self.by_pattern(word)

    def by_spaced(self, word: str) -> bytes:
        """A leading word is looked up among those that stand alone, so that it is stored and encoded once."""
        if word.isalpha():
            return self.piece(" " + word)
        first, *rest = self.splitter.find(" " + word)
        start = first[1:]
        return (self.spaced[start] if start.isalpha() else self.pieces[first]) + b"".join(map(self.pieces.__getitem__, rest))

    def plain(self, text: str) -> bytes:
        """The ids of a text for which ``splitter.plain`` holds."""
        if self.splitter.kind == "word":
            return b"".join(map(self.words.__getitem__, lower(text).split()))
        if "  " in text:
            return self.by_pattern(text)
        first, *rest = text.split(" ")
        return self.words[first] + b"".join(map(self.spaced.__getitem__, rest))
