"""Vectorised text primitives over Arrow string buffers.

Texts reach Python as Arrow batches.  Everything here works on the UTF-8 bytes of many texts at once with
numpy, in blocks of bounded size, so that no Python loop runs per word.  A text that is longer than a block
forms a block of its own: texts are never cut.

A *word* is a maximal run of bytes that are ASCII letters, digits, underscores or parts of a non-ASCII
character.  Case is folded for ASCII and for the two-byte Latin letters from À to Þ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33, _S29 = np.uint64(33), np.uint64(29)

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, for the positions below n."""
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits."""
    h = (h ^ (h >> _S33)) * _M1
    h = (h ^ (h >> _S29)) * _M2
    return h ^ (h >> _S33)


def as_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole texts of about `size` bytes."""
    data, at = as_buffer(column)
    first, n = 0, len(at) - 1
    while first < n:
        last = min(n, max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1))
        yield first, last, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and two-byte Latin letters."""
    out = _FOLD[data]
    if len(out) > 1:
        tail = out[1:]
        hit = (out[:-1] == 0xC3) & (tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)
        tail[hit] += 0x20
    return out


class Words:
    """The words of a block: `start` and `end` in bytes, `row` (text number), `of` (first word of each text, n + 1)."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at = fold(data), at
        is_word = _WORD[self.data]
        edge = np.zeros(len(is_word) + 1, bool)
        if len(is_word):
            edge[0], edge[-1] = is_word[0], is_word[-1]
            np.not_equal(is_word[1:], is_word[:-1], out=edge[1:-1])
        cut = at[1:-1]
        cut = cut[(cut > 0) & (cut < len(is_word))]
        joined = cut[is_word[cut] & is_word[cut - 1]]
        where = np.flatnonzero(edge)
        if len(joined):  # two texts that touch: a word ends and another begins there
            where = np.sort(np.concatenate([where, np.unique(joined), np.unique(joined)]))
        self.start, self.end = where[0::2], where[1::2]
        self.of = np.searchsorted(self.start, at)
        self._sums: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.of))

    def hashes(self, most: int = 0) -> np.ndarray:
        """A 64-bit hash of each word, or of its first `most` bytes."""
        up, down = powers(len(self.data) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=self._sums[1:])
        end = np.minimum(self.end, self.start + most) if most else self.end
        return mix((self._sums[end] - self._sums[self.start]) * down[self.start])


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within a text, and where each text's begin (n + 1 offsets).

    A text of fewer words, but at least one, has a single shingle of all its words.
    """
    h = words.hashes()
    count = np.diff(words.of)
    weights = mix(np.arange(1, n + 1, dtype=np.uint64) * _BASE)
    weights |= np.uint64(1)
    total = h * weights[0]
    for j in range(1, n):
        total[:-j] += h[j:] * weights[j]
    keep = np.ones(len(h), bool)
    last = words.of[1:]
    for j in range(1, n):  # the last n - 1 words of a text begin no shingle
        at = last - j
        keep[at[at >= words.of[:-1]]] = False
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        first = words.of[:-1][short]
        value = np.zeros(len(short), np.uint64)
        for j in range(n - 1):
            has = count[short] > j
            value[has] += h[first[has] + j] * weights[j]
        total[first] = value + count[short].astype(np.uint64)
        keep[first] = True
    sizes = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    return mix(total[keep]), np.concatenate([[0], np.cumsum(sizes)])
