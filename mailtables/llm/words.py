"""Words, their hashes and shingles of many texts at once, on the UTF-8 bytes of Arrow columns.

A word is a run of bytes outside ``\\x20`` and ``\\x09-\\x0D``. Hashes are 64 bits wide and equal
words have equal hashes; different ones collide with a probability of about 2**-64 a pair.
"""

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
U = np.uint64
_BASE, _JOIN = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1
_MASK = (1 << 64) - 1


def mix(x, seed=0):
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ U((seed * 0xC2B2AE3D27D4EB4F) & _MASK)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_PLAIN = mix(np.arange(1, 257, dtype=np.uint64), 1)
_LOWER = _PLAIN.copy()
_LOWER[65:91] = _PLAIN[97:123]
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
# Bytes outside letters, digits and characters beyond ASCII.
MARKS = np.ones(256, bool)
MARKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_powers = {}


def _power(base, n):
    """1, base, base**2, ... modulo 2**64, at least ``n`` of them."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(n, PIECE_BYTES + 1)
        known = np.full(size, base, dtype=np.uint64)
        known[0] = 1
        known = _powers[base] = np.multiply.accumulate(known)
    return known


def pieces(column, limit=PIECE_BYTES):
    """``(first row, bytes, row starts)`` of runs of whole texts of about ``limit`` bytes.

    A NULL counts as an empty text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("")
    _, where, data = column.buffers()
    if not len(column):
        return
    at = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield row, data[at[row] : at[last]], (at[row : last + 1] - at[row]).astype(np.int64)
        row = last


class Words:
    """The words of a run of texts: ``start`` and ``end`` bytes, ``hash``, and ``first`` word of each text."""

    def __init__(self, data, rows, lower=False, between=_BLANK):
        blank = np.ones(len(data) + 2, np.int8)
        blank[1:-1] = between[data]
        # A text's end also ends a word, so cut there as if a blank stood between.
        change = np.diff(blank)
        begins, ends = change[:-1] == -1, change[1:] == 1
        inner = rows[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        begins[inner] |= blank[inner + 1] == 0
        ends[inner - 1] |= blank[inner] == 0
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, rows)
        self.count = np.diff(self.first)
        table = _LOWER if lower else _PLAIN
        power = _power(_BASE, len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * power[: len(data)], out=total[1:])
        inverse = _power(pow(_BASE, -1, 1 << 64), len(data) + 1)
        self.hash = mix((total[self.end] - total[self.start]) * inverse[self.start])

    def windows(self, size):
        """``(hash, text)`` of every run of ``size`` words inside one text, by position."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        joined = np.zeros(n, np.uint64)
        for k in range(size):
            joined = joined * U(_JOIN) + self.hash[k : n + k]
        text = np.repeat(np.arange(len(self.count)), self.count)
        inside = text[:n] == text[size - 1 :]
        at = np.flatnonzero(inside)
        return mix(joined[at], size), text[at], at


def shingle_sets(data, rows, size=5):
    """The sorted distinct shingle hashes of each text, one after the other, and where each starts.

    A text with fewer words has one shingle, all its words; one without words has none.
    """
    words = Words(data, rows, lower=True)
    hashes, text, _ = words.windows(size)
    counts = np.maximum(words.count - size + 1, 0)
    short = np.flatnonzero((words.count > 0) & (words.count < size))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = words.count[short] > k
            whole[has] = whole[has] * U(_JOIN) + words.hash[words.first[short[has]] + k]
        hashes = np.insert(hashes, np.searchsorted(text, short), mix(whole, 100) + words.count[short].astype(np.uint64))
        counts[short] = 1
    at = np.concatenate([[0], np.cumsum(counts)])
    for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
        hashes[i:j].sort()
    keep = np.ones(len(hashes), bool)
    keep[1:] = hashes[1:] != hashes[:-1]
    keep[at[:-1][counts > 0]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return hashes[keep], kept[at]
