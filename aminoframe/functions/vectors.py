"""Figures of whole batches of sequences at once, in numpy, for what array lambdas would compute a value at a time.

An array is (values, sizes): the values of all sequences one after another, and how many each has.  ``Recipes`` says how
arrays come from the residues and which figures are wanted of them; ``figures`` computes a batch.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partialmethod

import numpy as np
import pyarrow as pa

from .alphabet import RESIDUES

#: Residues of a batch that are computed together (some descriptors hold 25 numbers for each and more), and cells of a table
#: with a row for each sequence.
CHUNK, CELLS = 1 << 17, 1 << 22
_NUMBER = np.full(256, -1, dtype=np.int64)
_NUMBER[[ord(a) for a in RESIDUES]] = np.arange(len(RESIDUES))
Array = tuple[np.ndarray, np.ndarray]


#: Figures of a scale over all of a sequence; at an end only the first.
SCALED = ("mean", "std", "min", "max", "median")


def _pair_weights(kind: str, *args) -> np.ndarray:
    """A weight for each ordered pair of residues.

    "product" and "sum" of a scale's values (in the order of the alphabet), "square": mean squared difference over some
    scales, "inside": both in a group, "across": one in either of two groups.
    """
    if kind == "product":
        return np.outer(args[0], args[0])
    if kind == "sum":
        return np.add.outer(np.array(args[0]), np.array(args[0]))
    if kind == "square":
        return np.mean([np.subtract.outer(np.array(s), np.array(s)) ** 2 for s in args], axis=0)
    a, b = (np.array([r in group for r in RESIDUES], dtype=np.float64) for group in (args[0], args[-1]))
    return np.maximum(np.outer(a, b), np.outer(b, a))


@dataclass
class Recipes:
    """``arrays``: name to (what, arguments); ``figures``: output column to (figure, array, arguments)."""

    arrays: dict[str, tuple] = field(default_factory=dict)
    figures: dict[str, tuple] = field(default_factory=dict)

    def only(self, wanted: Callable[[str], bool]) -> Recipes:
        return Recipes(self.arrays, {k: v for k, v in self.figures.items() if wanted(k)})

    def kind(self, name: str) -> str:
        return "array<double>" if self.figures[name][0] in ("table", "scaled") else "double"

    def widest(self) -> int:
        """Cells that a sequence takes in the widest table."""
        pairs = len(RESIDUES) ** 2
        return max([1, *(len(RESIDUES) ** f[1] for f in self.figures.values() if f[0] == "table"), *(pairs for f in self.figures.values() if f[0] == "coupled"), *(len(SCALED) * len(f[1]) for f in self.figures.values() if f[0] == "scaled")])


def _owner(sizes: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(sizes)), sizes)


def _place(sizes: np.ndarray) -> np.ndarray:
    """Each value's place in its sequence."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _windows(sizes: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows of ``w`` values begin, and how many each sequence has."""
    return np.flatnonzero(_place(sizes) + w <= np.repeat(sizes, sizes)), np.maximum(sizes - w + 1, 0)


def _shifted(v: np.ndarray, w: int, j: int) -> np.ndarray:
    """The ``j``-th value of every window of ``w``, also of those that reach into the next sequence."""
    return v[j : max(len(v) - w + 1, 0) + j]


class _Batch:
    """The arrays of some sequences; each is made when it is first asked for.

    They are kept in a dict that doesn't lead back to the batch, so that they go with it and don't wait for the garbage
    collector, which numbers of arrays don't wake.
    """

    def __init__(self, recipes: Recipes, seqs: list[bytes]) -> None:
        self.recipes, self.rows, self.seqs = recipes, len(seqs), seqs
        self.n = np.fromiter(map(len, seqs), np.int64, len(seqs))
        self.codes = np.frombuffer(b"".join(seqs), dtype=np.uint8)
        self.owner = _owner(self.n)
        self.kept: dict[tuple, object] = {}

    def _once(self, what: str, *args):
        if (key := (what, *args)) not in self.kept:
            self.kept[key] = getattr(self, what)(*args)
        return self.kept[key]

    array, moments, words, grouped = partialmethod(_once, "_array"), partialmethod(_once, "_moments"), partialmethod(_once, "_words"), partialmethod(_once, "_grouped")
    couplings, members, found = partialmethod(_once, "_couplings"), partialmethod(_once, "_members"), partialmethod(_once, "_found")

    def _array(self, name: str) -> Array:
        what, *args = self.recipes.arrays[name]
        return getattr(self, "_" + what)(*args)

    def _scale(self, table: tuple[float, ...]) -> Array:
        return np.array([0.0] * 65 + list(table) + [0.0] * (256 - 65 - len(table)))[self.codes], self.n

    def _roll(self, name: str, w: int) -> Array:
        v, sizes = self.array(name)
        at, out = _windows(sizes, w)
        return sum(_shifted(v, w, j) * (1.0 / w) for j in range(w))[at], out

    def _entropy(self, w: int) -> Array:
        """log2(w) less the mean log2 of how often each residue of the window stands in it."""
        at, out = _windows(self.n, w)
        logs = np.log2(np.maximum(np.arange(w + 1), 1))
        often = [np.ones(max(len(self.codes) - w + 1, 0), np.min_scalar_type(w)) for _ in range(w)]
        for i in range(w):
            for j in range(i):
                same = _shifted(self.codes, w, i) == _shifted(self.codes, w, j)
                often[i] += same
                often[j] += same
        total = sum(logs[c] for c in often)[at]
        return np.maximum(0.0, np.log2(w) - total / w), out

    def _known(self, name: str, letters: str) -> Array:
        v, _ = self.array(name)
        keep = np.isin(self.codes, [ord(a) for a in letters])
        return v[keep], np.bincount(self.owner[keep], minlength=self.rows)

    def _members(self, letters: str) -> np.ndarray:
        """Where residues of a group stand in the batch."""
        return np.flatnonzero(np.isin(np.arange(256), [ord(a) for a in letters])[self.codes])

    def _places(self, letters: str) -> Array:
        """Places of a group's residues, from 1."""
        at = self.members(letters)
        begin = np.cumsum(self.n) - self.n
        return (at - begin[self.owner[at]] + 1).astype(np.float64), np.bincount(self.owner[at], minlength=self.rows)

    def _gaps(self, name: str) -> Array:
        """Distances of neighbouring places."""
        v, sizes = self.array(name)
        at, out = _windows(sizes, 2)
        return v[at + 1] - v[at], out

    def _near(self, name: str) -> Array:
        """For each place the distance of the nearest other one; none for a single place."""
        v, sizes = self.array(name)
        at, _ = _windows(sizes, 2)
        gap, out = v[at + 1] - v[at], np.full(len(v), np.inf)
        out[at] = gap
        out[at + 1] = np.minimum(out[at + 1], gap)
        return out[np.isfinite(out)], np.where(sizes > 1, sizes, 0)

    def _absdiff(self, a: str, b: str) -> Array:
        return np.abs(self.array(a)[0] - self.array(b)[0]), self.array(a)[1]

    def _difference(self, a: str, b: str) -> Array:
        return self.array(a)[0] - self.array(b)[0], self.array(a)[1]

    def _shift(self, name: str, by: float) -> Array:
        return self.array(name)[0] + by, self.array(name)[1]

    def _product(self, a: str, b: str) -> Array:
        return self.array(a)[0] * self.array(b)[0], self.array(a)[1]

    def _repeats(self, k: int, inner: int) -> Array:
        """1 less the share of different words among ``inner`` neighbouring words of ``k`` residues."""
        v, sizes = self.words(k)
        at, out = _windows(sizes, inner)
        fresh = np.ones(len(at))
        for j in range(1, inner):
            new = np.ones(len(at), dtype=bool)
            for i in range(j):
                new &= v[at + i] != v[at + j]
            fresh += new
        return 1 - fresh / inner, out

    def _words(self, k: int) -> Array:
        """Overlapping words of ``k`` residues as numbers."""
        at, out = _windows(self.n, k)
        number = _NUMBER[self.codes]
        v = np.zeros(len(at), dtype=np.int64)
        for j in range(k):
            v = v * len(RESIDUES) + number[at + j]
        return v, out

    # Figures: one value a sequence.
    def sums(self, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        out, some = np.zeros(self.rows), sizes > 0
        if len(values):
            out[some] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[some], dtype=np.float64)
        return out

    def _moments(self, name: str) -> dict[str, np.ndarray]:
        v, sizes = self.array(name)
        out = {k: np.full(self.rows, np.nan) for k in ("low", "high", "first", "last")}
        some = sizes > 0
        if len(v):
            begin = (np.cumsum(sizes) - sizes)[some]
            out["low"][some], out["high"][some] = np.minimum.reduceat(v, begin), np.maximum.reduceat(v, begin)
            out["first"][some], out["last"][some] = v[begin], v[begin + sizes[some] - 1]
        out["mean"] = self.sums(v, sizes) / sizes
        out["std"] = np.sqrt(self.sums((v - np.repeat(out["mean"], sizes)) ** 2, sizes) / sizes)
        return out

    def stat(self, name: str, which: str) -> np.ndarray:
        m = self.moments(name)
        return m[which] if which in m else {"min": m["low"], "max": m["high"], "amplitude": m["high"] - m["low"], "start_end_diff": m["last"] - m["first"]}[which]

    def nearest(self, a: str, b: str) -> np.ndarray:
        """Mean distance of the residues of ``a`` to the nearest of ``b``: both in order, each of ``a`` between two of ``b``."""
        here, there = self.members(a), self.members(b)
        if not len(there):
            return np.full(self.rows, np.nan)
        own, right = self.owner[here], np.searchsorted(there, here)
        distance = np.full(len(here), np.inf)
        for at in (np.maximum(right - 1, 0), np.minimum(right, len(there) - 1)):
            near = np.where(self.owner[there[at]] == own, np.abs(there[at] - here), np.inf)
            np.minimum(distance, near, out=distance)
        mean = np.bincount(own, weights=distance, minlength=self.rows) / np.bincount(own, minlength=self.rows)
        return np.where(np.isfinite(mean), mean, np.nan)

    def median(self, name: str) -> np.ndarray:
        v, sizes = self.array(name)
        ordered = v[np.lexsort((v, _owner(sizes)))]
        begin, some, out = np.cumsum(sizes) - sizes, sizes > 0, np.full(self.rows, np.nan)
        low, high = (begin + (sizes - 1) // 2)[some], (begin + sizes // 2)[some]
        out[some] = (ordered[low] + ordered[high]) / 2.0
        return out

    def share(self, name: str, sign: str, value: float) -> np.ndarray:
        v, sizes = self.array(name)
        hit = {"<": np.less, "<=": np.less_equal, ">": np.greater, ">=": np.greater_equal}[sign](v, value)
        return self.sums(hit, sizes) / sizes

    def _found(self, pattern: str, overlapping: bool, end: tuple[str, int] | None) -> dict[str, np.ndarray]:
        """Number of matches, and where the first and the last begin, by Python's own engine."""
        search, flags = re.compile(pattern), re.match(r"(?:\(\?[aimsux]+\))?", pattern)
        if overlapping:
            search = re.compile(f"(?={pattern[flags.end() :]})", search.flags)
        out = {k: np.full(self.rows, np.nan) for k in ("count", "first", "last")}
        for row, text in enumerate(self.seqs):
            text = text.decode()
            if end:
                text = text[: end[1]] if end[0] == "n" else text[-end[1] :]
            begins = [m.start() for m in search.finditer(text)] if text else []
            out["count"][row] = len(begins)
            if begins:
                out["first"][row], out["last"][row] = begins[0] + 1, begins[-1] + 1
        return out

    def searched(self, pattern: str, overlapping: bool, end: tuple[str, int] | None, which: str) -> np.ndarray:
        return self.found(pattern, overlapping, end)[which]

    def _couplings(self, letters: str, lag: int) -> dict[tuple, np.ndarray]:
        """All wanted sums over the pairs of residues at a lag: one table of pair counts, times a matrix of their weights.

        Residues that aren't in ``letters`` are left out before the lag is taken.
        """
        number, sizes = _NUMBER[self.codes], self.n
        if len(letters) < len(RESIDUES):
            keep = np.isin(self.codes, [ord(a) for a in letters])
            number, sizes = number[keep], np.bincount(self.owner[keep], minlength=self.rows)
        at, out = _windows(sizes, lag + 1)
        wide = len(RESIDUES) ** 2
        counts = np.bincount(_owner(out) * wide + number[at] * len(RESIDUES) + number[at + lag], minlength=self.rows * wide).reshape(self.rows, wide)
        weights = {f[3]: None for f in self.recipes.figures.values() if f[0] == "coupled" and f[1:3] == (letters, lag)}
        found = counts @ np.stack([_pair_weights(*w).ravel() for w in weights], axis=1)
        return dict(zip(weights, found.T, strict=True))

    def coupled(self, letters: str, lag: int, weight: tuple) -> np.ndarray:
        return self.couplings(letters, lag)[weight]

    def _grouped(self, k: int) -> tuple[np.ndarray, ...]:
        """Of each distinct word of each sequence: sequence, count, first and last place; and each place's count."""
        v, sizes = self.words(k)
        key = _owner(sizes) * len(RESIDUES) ** k + v
        order = np.argsort(key, kind="stable")
        head = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]]) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.r_[head, len(key)])
        of_place = np.empty(len(key), dtype=np.int64)
        of_place[order] = np.repeat(count, count)
        return _owner(sizes)[order[head]], count, order[head], order[head + count - 1], of_place

    def word_figure(self, k: int, which: str) -> np.ndarray:
        owner, count, first, last, of_place = self.grouped(k)
        sizes = self.words(k)[1]
        some = np.where(sizes > 0, 0.0, np.nan)
        rep = count > 1
        add = lambda values, at: np.bincount(at, weights=values, minlength=self.rows)
        total = add(count[rep], owner[rep])

        def most(values: np.ndarray, at: np.ndarray) -> np.ndarray:
            out = np.zeros(self.rows)
            np.maximum.at(out, at, values)
            return out

        if which == "total":
            return total
        if which == "size":
            return sizes.astype(np.float64)
        if which == "kinds":
            return add(np.ones(len(count)), owner)
        if which == "top":
            return most(count, owner) + some
        if which == "span":
            return add((last - first)[rep], owner[rep]) / np.where(total > 0, add(np.ones(int(rep.sum())), owner[rep]), np.nan)
        if which == "entropy":
            share = count[rep] / total[owner[rep]]
            return 0.0 - add(share * np.log2(share), owner[rep]) + some
        if which == "concentration":
            return most(count[rep], owner[rep]) / np.maximum(total, 1) + some
        if which != "longest":
            raise ValueError(which)
        hit = of_place > 1
        opens = hit & np.r_[True, ~hit[:-1]] | hit & (_place(sizes) == 0)
        run = np.cumsum(opens)[hit]
        length = np.bincount(run)[1:] if len(run) else np.zeros(0, np.int64)
        return most(length, _owner(sizes)[np.flatnonzero(opens)]) + some

    def table(self, k: int) -> pa.Array:
        """Counts of all words of ``k`` residues, in order."""
        wide = len(RESIDUES) ** k
        v, sizes = self.words(k)
        counts = np.bincount(_owner(sizes) * wide + v, minlength=self.rows * wide).astype(np.float64)
        return pa.FixedSizeListArray.from_arrays(pa.array(counts), wide).cast(pa.list_(pa.float64()))

    def scaled(self, scales: tuple[tuple[float | None, ...], ...], end: tuple[str, int] | None) -> pa.Array:
        """Figures of many scales from the residue counts: one product with the matrix of the scales for all means, order statistics by running counts.

        A residue without a value in a scale doesn't count there.  ``end``: means of the first ("n") or last ("c") residues.
        """
        wide, owner, number = len(RESIDUES), self.owner, _NUMBER[self.codes]
        if end and end != ("c", 0):
            place = _place(self.n)
            keep = place < end[1] if end[0] == "n" else place >= (self.n - end[1])[owner]
            owner, number = owner[keep], number[keep]
        counts = np.bincount(owner * wide + number, minlength=self.rows * wide).reshape(self.rows, wide).astype(np.float64)
        known = np.array([[v is not None for v in s] for s in scales])
        matrix = np.array([[v or 0.0 for v in s] for s in scales])
        sizes = counts @ known.T
        means = counts @ matrix.T / sizes
        if end:
            made = means
        else:
            made = np.full((self.rows, len(scales), len(SCALED)), np.nan)
            made[:, :, 0] = means
            for j, (values, has) in enumerate(zip(matrix, known, strict=True)):
                order = np.argsort(values[has], kind="stable")
                c, v, n, some = counts[:, has][:, order], values[has][order], sizes[:, j], sizes[:, j] > 0
                if not some.any():
                    continue
                made[:, j, 1] = np.sqrt((c * (v - means[:, j : j + 1]) ** 2).sum(axis=1) / n)
                running = c.cumsum(axis=1)
                at = lambda rank, running=running, v=v: v[np.minimum((running <= rank[:, None]).sum(axis=1), len(v) - 1)]
                last = np.maximum(n - 1, 0)
                for k, value in ((2, at(np.zeros(self.rows))), (3, at(last)), (4, (at(last // 2) + at(n // 2)) / 2)):
                    made[some, j, k] = value[some]
        flat = made.reshape(self.rows, -1)
        return pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), flat.shape[1]).cast(pa.list_(pa.float64()))

    def figure(self, what: str, *args) -> pa.Array:
        with np.errstate(divide="ignore", invalid="ignore"):
            found = getattr(self, what)(*args)
        #: Sums over nothing at all are integers in numpy.
        return found if isinstance(found, pa.Array) else pa.array(np.asarray(found, dtype=np.float64), from_pandas=False)


def _counted(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, pa.Array, pa.Array]]:
    """Of parts of batches of (id, seq, n): the part, how many words of ``k`` residues, of any length, each sequence has, and of each distinct one the sequence, the word and the count."""
    for batch in batches:
        ends, lo = np.cumsum(batch.column(2).to_numpy()), 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + max(1, 8 * CHUNK // k), side="right")))
            part = batch.slice(lo, hi - lo)
            made = _Batch(Recipes(), [s.encode() for s in part.column(1).to_pylist()])
            at, sizes = _windows(made.n, k)
            spelled = np.lib.stride_tricks.sliding_window_view(made.codes, k)[at] if len(at) else np.zeros((0, k), np.uint8)
            known = pa.FixedSizeBinaryArray.from_buffers(pa.binary(k), len(at), [None, pa.py_buffer(np.ascontiguousarray(spelled))]).dictionary_encode()
            key, count = np.unique(_owner(sizes) * max(1, len(known.dictionary)) + known.indices.to_numpy(), return_counts=True)
            owner, word = np.divmod(key, max(1, len(known.dictionary)))
            yield part, sizes, owner, known.dictionary.take(pa.array(word)).cast(pa.binary()).cast(pa.string()), pa.array(count.astype(np.float64))
            lo = hi


def word_maps(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, total, words) of batches of (id, seq, n): the words of ``k`` residues that a sequence has, in a map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sizes, owner, words, count in _counted(k, batches):
            offsets = pa.array(np.r_[0, np.cumsum(np.bincount(owner, minlength=len(sizes)))].astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.MapArray.from_arrays(offsets, words, count)], names=["id", "total", "words"])

    return run


def word_rows(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, kmer, n) of batches of (id, seq, n): a row for each word of ``k`` residues that a sequence has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, owner, words, count in _counted(k, batches):
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), words, count], names=["id", "kmer", "n"])

    return run


def stage(recipes: Recipes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the figures to batches of (id, seq, n)."""

    most = max(1, CELLS // recipes.widest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(batch.column(2).to_numpy())
            lo = 0
            while lo < batch.num_rows:
                before = ends[lo - 1] if lo else 0
                hi = min(lo + most, max(lo + 1, int(np.searchsorted(ends, before + CHUNK, side="right"))))
                part = batch.slice(lo, hi - lo)
                made = _Batch(recipes, [s.encode() for s in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, *(made.figure(*f) for f in recipes.figures.values())], names=["id", "seq", "n", *recipes.figures])
                lo = hi

    return run
