"""Cells of texts: parts that a vocabulary encodes independently of what stands around them, and their values."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import _encoded, last_cut, row_runs, text_bytes

#: Bytes of one-byte characters that are neither white space nor control.
_SEEN = np.zeros(256, dtype=bool)
_SEEN[33:127] = True
#: First bytes of two- and three-byte characters among which there is no white space (U+00C0-07FF, U+4000-DFFF).
_LEAD_2 = np.zeros(256, dtype=bool)
_LEAD_2[0xC3:0xE0] = True
_LEAD_3 = np.zeros(256, dtype=bool)
_LEAD_3[0xE4:0xEE] = True


def safe_gaps(data: np.ndarray, gap: int, offsets: np.ndarray | None = None) -> np.ndarray:
    """Places of single ``gap`` bytes between two characters of one text which are surely no white space."""
    inner = data == gap
    inner[:1] = inner[-1:] = False
    if offsets is not None:
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        inner[edges] = inner[edges - 1] = False
    at = np.flatnonzero(inner)
    before, after = data[at - 1], data[at + 1]
    left = _SEEN[before]
    wide = np.flatnonzero(~left & (before >= 128))
    if len(wide):
        i = at[wide]
        left[wide] = _LEAD_2[data[np.maximum(i - 2, 0)]] & (i >= 2) | _LEAD_3[data[np.maximum(i - 3, 0)]] & (data[np.maximum(i - 2, 0)] >= 128) & (i >= 3)
    return at[left & (_SEEN[after] | _LEAD_2[after] | _LEAD_3[after])]


def pieces(column: pa.Array, chunk_bytes: int, cuts: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """(first row, bytes, document offsets, whether the row goes on in the next piece) of about ``chunk_bytes``.

    Texts of more bytes are parted before the places that ``cuts`` names; one without such places comes whole.
    """
    data, offsets = text_bytes(column)
    for lo, hi in row_runs(offsets, chunk_bytes):
        part = data[offsets[lo] : offsets[hi]]
        if len(part) <= chunk_bytes or hi > lo + 1:
            yield lo, part, offsets[lo : hi + 1] - offsets[lo], False
            continue
        at = 0
        while at < len(part):
            stop = last_cut(part, at, chunk_bytes, cuts)
            yield lo, part[at:stop], np.array([0, stop - at]), stop < len(part)
            at = stop


class Units:
    """The values (runs of numbers) of units by their bytes, kept for the ``entries`` units that were used last."""

    def __init__(self, entries: int) -> None:
        self.entries, self.calls = entries, 0
        self.known = pa.array([], pa.large_binary())
        self.flat = np.zeros(0, np.uint32)
        self.begin, self.count, self.used = (np.zeros(0, np.int64) for _ in range(3))

    def _forget(self) -> None:
        """Leaves the units of the latest calls."""
        keep = np.sort(np.argpartition(-self.used, self.entries)[: self.entries])
        self.known, self.flat = self.known.take(pa.array(keep)), self._run(keep)
        self.count, self.used = self.count[keep], self.used[keep]
        self.begin = np.cumsum(self.count) - self.count

    def _run(self, which: np.ndarray) -> np.ndarray:
        """The values of the units one after another."""
        count = self.count[which]
        total = np.cumsum(count)
        return self.flat[np.repeat(self.begin[which] - (total - count), count) + np.arange(total[-1] if len(total) else 0)]

    def values(self, data: np.ndarray, starts: np.ndarray, offsets: np.ndarray, compute: Callable[[list[bytes]], tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(all values of all units in order, how many each unit has, units before each text).

        Units begin at ``starts`` and where texts do, and reach to the next one.  ``compute`` is called once with those
        that have no values yet; it returns all their values, and where each unit's begin and how many they are.
        """
        begins = np.zeros(len(data) + 1, dtype=bool)
        begins[starts] = begins[offsets] = True
        start = np.flatnonzero(begins[:-1])
        number, spelling = _encoded(data, np.diff(np.r_[start, len(data)]))
        if len(self.known) > 2 * self.entries:
            self._forget()
        self.calls += 1
        place = pc.index_in(spelling, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            found = spelling.take(pa.array(new))
            flat, begin, count = compute(found.to_pylist())
            place[new] = len(self.known) + np.arange(len(new))
            self.begin, self.count = np.r_[self.begin, begin + len(self.flat)], np.r_[self.count, count]
            self.flat, self.used = np.r_[self.flat, flat], np.r_[self.used, np.zeros(len(new), np.int64)]
            self.known = pa.concat_arrays([self.known, found])
        self.used[place] = self.calls
        which = place[number]
        return self._run(which), self.count[which], np.searchsorted(start, offsets)
