"""A run-compressed Burrows-Wheeler index over a collection of short byte strings.

The transform is kept as runs; at each run's first row there is a sample: how long a match the
row has with the one before it after one step to the left. Streaming every string backwards through
the runs then needs no suffix array: inside a run the match with the row before grows by one for
each step, and at a run's end the sample replaces it. All strings step together.

Strings that aren't in the index are streamed against it, too (``follow``): from the row at which a string
of the index ends, the runs give symbol after symbol, and with them how far the two agree.
"""

from __future__ import annotations

import numpy as np


WIDTH = 7
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def pieces(symbols: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The next seven symbols from each position as one number; nothing follows an end mark."""
    n, key = len(symbols), np.zeros(len(symbols), np.uint64)
    for k in range(WIDTH):
        piece = np.zeros(n, np.uint64)
        piece[: n - k] = symbols[k:]
        key = key << np.uint64(9) | np.where(room > k, piece, 0)
    return key


def suffix_order(key: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes, by doubling; equal ones go by position.

    key: the next symbols from each position; room: how many symbols are left, with the end mark.
    Keys and positions of what is still tied are sorted together as single numbers where they fit.
    """
    n = len(key)
    bits = np.uint64(max(1, int(n).bit_length()))
    packed = 3 * int(bits) <= 64
    order = np.argsort(key)  # ties are put in order below
    ranked = key[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    width, longest = WIDTH, int(room.max(initial=0))
    while width < longest:
        at = np.flatnonzero(~(new & np.concatenate([new[1:], [True]])))
        if not len(at):
            break
        pos = order[at]
        after = np.where(room[pos] > width, rank[np.minimum(pos + width, n - 1)] + 1, 0)
        first = rank[pos]
        if packed:
            whole = np.sort((first.astype(np.uint64) << (bits + bits)) | (after.astype(np.uint64) << bits) | pos.astype(np.uint64))
            pos, whole = (whole & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), whole >> bits
            fresh = np.concatenate([[True], whole[1:] != whole[:-1]])
        else:
            again = np.lexsort((pos, after, first))
            pos, after, first = pos[again], after[again], first[again]
            fresh = np.concatenate([[True], (first[1:] != first[:-1]) | (after[1:] != after[:-1])])
        order[at] = pos
        new[at] = fresh
        rank[pos] = np.maximum.accumulate(np.where(fresh, at, 0))
        width *= 2
    return order


class RunIndex:
    """Runs of the transform with samples at their first rows."""

    def __init__(self, strings: list[bytes], least: int):
        self.least = least
        sizes = np.array([len(s) + 1 for s in strings])
        ends = np.cumsum(sizes) - 1
        self.sizes, n = sizes, int(sizes.sum())
        symbols = np.zeros(n, np.uint64)
        flat = np.ones(n, bool)
        flat[ends] = False
        symbols[flat] = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint64) + np.uint64(1)
        room = np.repeat(ends, sizes) - np.arange(n) + 1
        key = pieces(symbols, room)
        order = suffix_order(key, room)
        before = symbols[order - 1].astype(np.int64)  # an end mark before a string's first symbol
        heads = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        self.starts, self.chars = heads, before[heads]
        # a bitmap of run heads with the number of heads before each word
        bits = np.zeros(-(-n // 64) * 64, bool)
        bits[heads] = True
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.ranks = np.cumsum(np.bitwise_count(self.words), dtype=np.int64) - np.bitwise_count(self.words)
        chars = self.chars
        lengths = np.diff(np.append(heads, n))
        by_char = np.argsort(chars, kind="stable")
        self.target = np.empty(len(heads), np.int64)
        self.target[by_char] = np.concatenate([[0], np.cumsum(lengths[by_char])[:-1]])
        self.sample = self._matches(key, room - 1, order, self.target)

    def run_of(self, rows: np.ndarray) -> np.ndarray:
        """The run that each row is in."""
        word = rows >> 6
        return self.ranks[word] + np.bitwise_count(self.words[word] & (ALL >> (63 - (rows & 63)).astype(np.uint64))) - 1

    def _matches(self, key: np.ndarray, left: np.ndarray, order: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The match of each row's suffix with the row before it, counted beyond ``least`` only roughly."""
        out = np.zeros(len(rows), np.int64)
        live = np.flatnonzero(rows > 0)
        a, b = order[rows[live]], order[rows[live] - 1]
        while len(live):
            differ = key[a] ^ key[b]
            same = np.zeros(len(live), np.int64)
            for k in range(1, WIDTH + 1):
                same += differ >> np.uint64(9 * (WIDTH - k)) == 0
            same = np.minimum(same, np.minimum(left[a], left[b]))
            out[live] += same
            on = (same == WIDTH) & (out[live] < self.least)
            live, a, b = live[on], a[on] + WIDTH, b[on] + WIDTH
        return out

    def stream(self):
        """Steps all strings backwards at once; yields (strings, position in each, row, match with the row before)."""
        rows = np.arange(len(self.sizes))  # the end marks' rows come first, in order
        left = self.sizes - 1
        match = np.zeros(len(rows), np.int64)
        own = np.flatnonzero(left > 0)
        rows, match, left = rows[own], match[own], left[own]
        while len(own):
            run = self.run_of(rows)
            into = rows - self.starts[run]
            match = np.where(into == 0, self.sample[run], match + 1)
            rows = self.target[run] + into
            left = left - 1
            yield own, left, rows, match
            more = left > 0
            if not more.all():
                own, rows, match, left = own[more], rows[more], match[more], left[more]

    def follow(self, member: np.ndarray, strings: list[bytes]) -> np.ndarray:
        """How many symbols, from the end, each string shares with the string of the index that it is held against."""
        sizes = np.array([len(x) for x in strings], np.int64)
        symbols = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 1
        match = np.zeros(len(strings), np.int64)
        own = np.flatnonzero(sizes > 0)
        rows, at, left = member[own].astype(np.int64), np.cumsum(sizes)[own] - 1, sizes[own]
        while len(own):
            run = self.run_of(rows)
            rows = self.target[run] + rows - self.starts[run]
            same = self.chars[run] == symbols[at]
            left = left - 1
            match[own] += same
            on = same & (left > 0)
            at = at - 1
            if not on.all():
                own, rows, at, left = own[on], rows[on], at[on], left[on]
        return match


def classes(index: RunIndex) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, class) of every substring of ``least`` bytes; equal ones have equal classes."""
    least = index.least
    of, at, row, match = [], [], [], []
    for own, left, rows, found in index.stream():
        far = index.sizes[own] - 1 - left >= least
        if far.any():
            of.append(own[far])
            at.append(left[far])
            row.append(rows[far])
            match.append(found[far])
    if not of:
        return (np.zeros(0, np.int64),) * 3
    of, at, row, match = map(np.concatenate, (of, at, row, match))
    order = np.argsort(row)
    number = np.cumsum(match[order] < least)
    return of[order], at[order], number
