"""Words of Arrow text batches as numpy arrays: offsets, exact numbers and 64-bit hashes, in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: Word bytes of ``[^\x20\x09-\x0D]+``.
PLAIN_MASK = np.ones(256, dtype=bool)
PLAIN_MASK[[9, 10, 11, 12, 13, 32]] = False
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing.
ALNUM_MASK = np.zeros(256, dtype=bool)
ALNUM_MASK[48:58] = ALNUM_MASK[65:91] = ALNUM_MASK[97:123] = ALNUM_MASK[128:] = True

CHUNK_BYTES = 7 << 17


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the ordered pair."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` values, from the hashes of its halves: no sum that structured texts could cancel."""
    if len(h) < k:
        return np.zeros(0, dtype=np.uint64)
    width = 1
    while 2 * width <= k:
        h = pair(h[:-width], h[width:])
        width *= 2
    return h if width == k else pair(h[: len(h) - (k - width)], h[k - width :])


@dataclass
class Words:
    """The words of some consecutive documents of a batch, or of a piece of one long document.

    ``first[d] .. first[d + 1]`` are the words of document ``d`` (row ``lo + d`` of the batch); ``start``/``end`` are
    byte offsets into ``data``, and ``offsets`` those of the documents.  ``number`` tells words apart exactly: it is the
    word's place in ``spelling``.  ``hash`` is each word's XXH3.

    A piece of a long document has ``base`` words before it, of which the last ``again`` stand in it once more;
    ``more`` says that another piece follows.
    """

    lo: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    offsets: np.ndarray
    number: np.ndarray
    spelling: pa.Array
    base: int = 0
    again: int = 0
    more: bool = False

    @property
    def hash(self) -> np.ndarray:
        """64-bit hashes of the words, the same in every batch."""
        distinct = np.fromiter(map(xxhash.xxh3_64_intdigest, self.spelling.to_pylist()), np.uint64, len(self.spelling))
        return distinct[self.number]

    def rows(self) -> slice:
        return slice(self.lo, self.lo + len(self.first) - 1)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, document offsets) of a text column without a copy; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data, offsets


def row_runs(offsets: np.ndarray, chunk_bytes: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``chunk_bytes``; a longer row is a run of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + chunk_bytes, side="right")) - 1)
        yield lo, hi
        lo = hi


def last_cut(data: np.ndarray, lo: int, chunk_bytes: int, cuts: Callable[[np.ndarray], np.ndarray], margin: int = 8) -> int:
    """Where a piece from ``lo`` ends: the last place at which the text may be parted within ``chunk_bytes``, or the first after.

    ``cuts`` tells for a run of bytes the places before which it may be parted; it sees ``margin`` bytes around them.
    """
    at, begin = lo + chunk_bytes, max(lo, lo + chunk_bytes // 2)
    while at < len(data):
        left = max(lo, begin - margin)
        found = cuts(data[left : min(len(data), at + margin)]) + left
        found = found[(found > lo) & (found <= at)]
        if len(found):
            return int(found[-1] if begin == lo + chunk_bytes // 2 else found[0])
        begin, at = at, at + chunk_bytes
    return len(data)


def _word_ends(mask: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    return lambda part: np.flatnonzero(mask[part[:-1]] & ~mask[part[1:]]) + 1


def _encoded(kept: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(number of each unit, spelling of each number) of units that stand one after another in ``kept``."""
    ends = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=ends[1:])
    units = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(kept))]).dictionary_encode()
    return units.indices.to_numpy(), units.dictionary


def _words(lo: int, data: np.ndarray, offsets: np.ndarray, mask: np.ndarray, fold: bool) -> Words:
    if fold:
        data = LOWER[data]
    n = len(data)
    inside = mask[data]
    opens, closes = inside.copy(), inside.copy()
    if n:
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        cuts = offsets[(offsets > 0) & (offsets < n)]
        opens[cuts] |= inside[cuts]
        closes[cuts - 1] |= inside[cuts - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    number, spelling = _encoded(data[inside], end - start)
    return Words(lo, data, start, end, np.searchsorted(start, offsets), offsets, number, spelling)


def words_of(column: pa.Array, mask: np.ndarray, fold: bool = False, chunk_bytes: int = CHUNK_BYTES, overlap: int = 0) -> Iterator[Words]:
    """Words of a text column, chunk by chunk; ``mask`` marks word bytes, ``fold`` lower-cases A-Z.

    A text of more than ``chunk_bytes`` comes in pieces cut at ends of words, each with the ``overlap`` words before it.
    """
    data, offsets = text_bytes(column)
    for lo, hi in row_runs(offsets, chunk_bytes):
        part = data[offsets[lo] : offsets[hi]]
        if len(part) <= chunk_bytes or hi > lo + 1:
            yield _words(lo, part, offsets[lo : hi + 1] - offsets[lo], mask, fold)
            continue
        at, back, base, again = 0, 0, 0, 0
        while at < len(part):
            stop = last_cut(part, at, chunk_bytes, _word_ends(mask))
            piece = part[back:stop]
            w = _words(lo, piece, np.array([0, len(piece)]), mask, fold)
            w.base, w.again, w.more = base, again, stop < len(part)
            yield w
            again = min(overlap, len(w.start))
            base += len(w.start) - again
            back = back + int(w.start[len(w.start) - again]) if again else stop
            at = stop
