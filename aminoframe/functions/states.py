"""Partial states of blocks of sequences, which add up to the figures of whole sequences.

A block holds its own residues and, behind them, the first of the next block, so that every window, word and pair of
residues begins in one block and lies in it.  Its state is counts, sums, extremes, first and last values, and the runs that
touch its ends.  ``fold`` has the aggregates that merge states in any order, ``figures`` what follows from the merged ones.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .alphabet import RESIDUES
from .vectors import CELLS, CHUNK, Array, Recipes, _Batch, _owner, _place

#: Arrays whose values stand for windows that begin at their places, or for single residues.
_BY_PLACE = ("scale", "roll", "entropy", "absdiff", "difference", "shift", "product", "repeats")
_WORD_FIGURES = ("size", "kinds", "top", "total", "entropy", "concentration", "span")
#: Longest words of which all counts are merged.
WORD_MOST = 6
RUNS = re.compile(r"(runs_[A-Z]+|codes_lengths)_(count|longest|in2|in3)")
_EDGE = pa.struct([("key", pa.string()), ("kind", pa.int32()), ("begin", pa.int64()), ("end", pa.int64())])
WORD = "id string, k int, word long, c long, first long, last long"


def merges(recipes: Recipes, name: str) -> bool:
    """Whether a figure of whole sequences follows from states of blocks."""
    what, *args = recipes.figures[name]
    if what in ("stat", "share"):
        recipe = recipes.arrays[args[0]]
        return recipe[0] in _BY_PLACE or recipe[0] == "places" or recipe[0] == "known" and recipes.arrays[recipe[1]][0] == "scale"
    if what == "median":
        return _scale(recipes, args[0]) is not None
    if what == "scaled":
        return args[1] != ("c", 0)
    if what == "coupled":
        return set(args[0]) == set(RESIDUES)
    return what == "word_figure" and args[1] in _WORD_FIGURES and args[0] <= WORD_MOST or what == "table" and args[0] <= 2


def _scale(recipes: Recipes, array: str) -> dict[str, float] | None:
    """The values of an array that has one for each residue, or for each of some."""
    what, *args = recipes.arrays[array]
    if what == "known" and recipes.arrays[args[0]][0] == "scale":
        table, letters = recipes.arrays[args[0]][1], args[1]
    elif what == "scale":
        table, letters = args[0], RESIDUES
    else:
        return None
    return {a: table[ord(a) - 65] for a in RESIDUES if a in letters}


class Plan:
    """Which states are needed for some figures and runs, how they merge, and what follows from them."""

    def __init__(self, recipes: Recipes, runs: Iterable[str], reach: int) -> None:
        """``reach``: residues at each end of a sequence that are kept."""
        self.recipes, self.runs, self.reach = recipes, sorted(runs), reach
        figures = recipes.figures.values()
        self.arrays = sorted({f[1] for f in figures if f[0] in ("stat", "share")})
        self.shares = [k for k, f in recipes.figures.items() if f[0] == "share"]
        self.pairs = [k for k, f in recipes.figures.items() if f[0] == "coupled"]
        self.words = sorted({f[1] for f in figures if f[0] in ("word_figure", "table")})
        self.tables = sorted({f[1] for f in figures if f[0] == "table"})

    def halo(self) -> int:
        """Residues of the next block that a block needs."""
        lags = [f[2] for f in self.recipes.figures.values() if f[0] == "coupled"]
        return max([0, *lags, *(k - 1 for k in self.words), *(self._wide(a) - 1 for a in self.arrays)])

    def _wide(self, array: str) -> int:
        what, *args = self.recipes.arrays[array]
        own = {"roll": lambda: args[1], "entropy": lambda: args[0], "repeats": lambda: args[0] + args[1] - 1}.get(what, lambda: 1)()
        return max([own, *(self._wide(a) + own - 1 for a in args if isinstance(a, str) and a in self.recipes.arrays)])

    def columns(self) -> list[tuple[str, str]]:
        """(name, type) of a state."""
        out = [("id", "string"), ("at", "long"), ("n", "long"), ("more", "boolean"), ("head", "string"), ("tail", "string"), *((f"count_seq_{a}", "long") for a in RESIDUES)]
        for a in self.arrays:
            out += [(f"{a}__n", "long"), *((f"{a}__{k}", "double") for k in ("mean", "square", "low", "high", "first", "last"))]
        out += [(f"{k}__sum", "double") for k in (*self.shares, *self.pairs)]
        out += [(f"{r}__{k}", "long") for r in self.runs for k in ("count", "longest", "in2", "in3")]
        return [*out, ("edges", "array<struct<key:string,kind:int,begin:long,end:long>>")]

    def fold(self) -> list[str]:
        """Aggregates over the states of a sequence; none depends on their order."""
        out = ["sum(n) AS n", *(f"sum(count_seq_{a}) AS count_seq_{a}" for a in RESIDUES)]
        #: Both ends for what looks at them only.  The last block may be short, so the one before it counts too.
        tail = f"right(concat(coalesce(max_by(tail, at) FILTER (WHERE more), ''), max_by(tail, at)), {self.reach})"
        out.append(f"CASE WHEN sum(n) <= {self.reach} THEN min_by(head, at) ELSE concat(min_by(head, at), {tail}) END AS seq")
        for a in self.arrays:
            some = f"FILTER (WHERE {a}__n > 0)"
            out += [f"sum({a}__n) AS {a}__n", f"sum({a}__n * {a}__mean) / sum({a}__n) AS {a}__mean", f"sum({a}__square) AS {a}__square", f"sum({a}__n * {a}__mean * {a}__mean) AS {a}__between"]
            out += [f"min({a}__low) AS {a}__low", f"max({a}__high) AS {a}__high", f"min_by({a}__first, at) {some} AS {a}__first", f"max_by({a}__last, at) {some} AS {a}__last"]
        out += [f"sum({k}__sum) AS {k}__sum" for k in (*self.shares, *self.pairs)]
        out += [f"{'max' if k == 'longest' else 'sum'}({r}__{k}) AS {r}__{k}" for r in self.runs for k in ("count", "longest", "in2", "in3")]
        return [*out, "sort_array(flatten(collect_list(edges))) AS edges"] if self.runs else out

    def joined_runs(self) -> list[tuple[str, str]]:
        """Runs through the ends of blocks: edges of one kind that meet are one run."""
        zero = "named_struct('kind', -1, 'last', -1L, 'length', 0L, 'count', 0L, 'longest', 0L, 'in2', 0L, 'in3', 0L)"
        close = "a.count + if(a.length > 0, 1L, 0L) AS count, greatest(a.longest, a.length) AS longest, a.in2 + if(a.length > 1, a.length, 0L) AS in2, a.in3 + if(a.length > 2, a.length, 0L) AS in3"
        fresh = f"struct(e.kind AS kind, e.end AS last, e.end - e.begin AS length, {close})"
        more = "struct(a.kind AS kind, e.end AS last, a.length + e.end - e.begin AS length, a.count AS count, a.longest AS longest, a.in2 AS in2, a.in3 AS in3)"
        end = f"struct(a.kind AS kind, a.last AS last, 0L AS length, {close})"
        return [(f"{r}__joined", f"aggregate(filter(edges, e -> e.key = '{r}'), {zero}, (a, e) -> if(e.begin = a.last AND e.kind = a.kind, {more}, {fresh}), a -> {end})") for r in self.runs]

    def figures(self) -> list[tuple[str, str]]:
        """(name, expression over the merged state) of the wanted figures and runs."""
        nan, out = "double('NaN')", []
        for name, (what, *args) in self.recipes.figures.items():
            a = args[0]
            if what == "stat":
                spread = f"CASE WHEN {a}__low = {a}__high THEN 0D ELSE sqrt(greatest({a}__square + {a}__between - {a}__n * {a}__mean * {a}__mean, 0D) / {a}__n) END"
                sql = {"mean": f"{a}__mean", "std": spread, "min": f"{a}__low", "max": f"{a}__high", "amplitude": f"{a}__high - {a}__low", "start_end_diff": f"{a}__last - {a}__first"}[args[1]]
                out.append((name, f"CASE WHEN {a}__n > 0 THEN {sql} ELSE {nan} END"))
            elif what == "share":
                out.append((name, f"CASE WHEN {a}__n > 0 THEN {name}__sum / {a}__n ELSE {nan} END"))
            elif what == "coupled":
                out.append((name, f"{name}__sum"))
            elif what == "median":
                out.append((name, self._median(_scale(self.recipes, a) or {})))
            elif what == "scaled":
                out.append((name, self._scaled(a, args[1])))
            elif what == "table":
                out.append((name, f"transform(sequence(0, {len(RESIDUES) ** a - 1}), i -> coalesce(element_at(words{a}__table, cast(i as bigint)), 0D))"))
            elif args[1] == "size":
                out.append((name, f"cast(greatest(n - {a - 1}, 0) as double)"))
            else:
                out.append((name, f"CASE WHEN n >= {a} THEN words{a}__{args[1]} ELSE {'0D' if args[1] in ('kinds', 'total') else nan} END"))
        for r in self.runs:
            both = lambda k, r=r: (f"{r}__{k}", f"{r}__joined.{k}")
            out += [(f"{r}_{k}", f"greatest(coalesce({both(k)[0]}, 0), {both(k)[1]})" if k == "longest" else f"coalesce({both(k)[0]}, 0) + {both(k)[1]}") for k in ("count", "longest", "in2", "in3")]
        return out

    @staticmethod
    def _median(scale: dict[str, float]) -> str:
        """From residue counts: the two middle values, by how many residues have a value or less."""
        below, letters = [], sorted(scale, key=scale.__getitem__)
        total = " + ".join(f"count_seq_{a}" for a in letters) or "0"
        for i, a in enumerate(letters):
            below.append((" + ".join(f"count_seq_{x}" for x in letters[: i + 1]), scale[a]))
        at = lambda rank: "CASE " + " ".join(f"WHEN {upto} > {rank} THEN double({v!r})" for upto, v in below) + " END"
        return f"CASE WHEN {total} > 0 THEN ({at(f'({total} - 1) div 2')} + {at(f'({total}) div 2')}) / 2 ELSE double('NaN') END"

    def _scaled(self, scales: tuple[tuple[float | None, ...], ...], end: tuple[str, int] | None) -> str:
        """The figures of all scales as an array, from residue counts."""
        nan, out = "double('NaN')", []
        text = f"{'left' if end[0] == 'n' else 'right'}(seq, {end[1]})" if end else ""
        count = {a: f"(length({text}) - length(replace({text}, '{a}', '')))" if end else f"count_seq_{a}" for a in RESIDUES}
        for values in scales:
            scale = {a: v for a, v in zip(RESIDUES, values, strict=True) if v is not None}
            n = "(" + (" + ".join(count[a] for a in scale) or "0") + ")"
            mean = "(" + (" + ".join(f"{count[a]} * double({v!r})" for a, v in scale.items()) or "0D") + f") / {n}"
            sql = [mean]
            if not end:
                square = " + ".join(f"{count[a]} * pow(double({v!r}) - m, 2)" for a, v in scale.items()) or "0D"
                low, high = (f"{f}({', '.join(f'CASE WHEN {count[a]} > 0 THEN double({v!r}) END' for a, v in scale.items())}, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE))" for f in ("least", "greatest"))
                sql += [f"element_at(transform(array({mean}), m -> sqrt(({square}) / {n})), 1)", low, high, self._median(scale)]
            out += [f"CASE WHEN {n} > 0 THEN {x} ELSE {nan} END" for x in sql]
        return f"array({', '.join(out)})"

    def word_figures(self) -> list[str]:
        """Aggregates over (k, word, c, first, last), a row for each word of a sequence."""
        out = []
        for k in self.words:
            of, rep = f"FILTER (WHERE k = {k})", f"FILTER (WHERE k = {k} AND c > 1)"
            total = f"sum(c) {rep}"
            out += [f"cast(count(c) {of} as double) AS words{k}__kinds", f"cast(max(c) {of} as double) AS words{k}__top", f"coalesce(cast({total} as double), 0D) AS words{k}__total", f"coalesce(avg(last - first) {rep}, double('NaN')) AS words{k}__span"]
            out += [f"coalesce(log2({total}) - sum(c * log2(c)) {rep} / {total}, 0D) AS words{k}__entropy", f"coalesce(max(c) {rep} / {total}, 0D) AS words{k}__concentration"]
            if k in self.tables:
                out.append(f"map_from_entries(collect_list(struct(word, cast(c as double))) {of}) AS words{k}__table")
        return out

    def _parts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
        """Batches of (id, at, own, halo) in chunks."""
        most = max(1, CELLS // max(self.recipes.widest(), 1))
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(2).cast(pa.binary())).fill_null(0).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < batch.num_rows:
                hi = min(lo + most, max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + CHUNK, side="right"))))
                yield _Block(self, batch.slice(lo, hi - lo))
                lo = hi

    def stage(self) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """States of batches of (id, at, own, halo)."""
        return lambda batches: (part.state() for part in self._parts(batches))

    def word_stage(self) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Words of batches of (id, at, own, halo), as ``WORD`` names them."""
        return lambda batches: (counts for part in self._parts(batches) for counts in part.word_counts())


class _Block(_Batch):
    """Blocks of a batch; arrays are over a block and its halo until ``cut`` takes the block's own part."""

    def __init__(self, plan: Plan, batch: pa.RecordBatch) -> None:
        own, halo = ([s.encode() for s in batch.column(i).to_pylist()] for i in (2, 3))
        super().__init__(plan.recipes, [a + b for a, b in zip(own, halo, strict=True)])
        self.plan, self.batch, self.text = plan, batch, own
        self.own, self.at = np.fromiter(map(len, own), np.int64, len(own)), batch.column(1).to_numpy()

    def cut(self, name: str) -> Array:
        what, *args = self.recipes.arrays[name]
        if what == "places":
            v, sizes = self.array(name)
            owner = _owner(sizes)
            keep = v <= self.own[owner]
            return v[keep] + self.at[owner[keep]], np.bincount(owner[keep], minlength=self.rows)
        if what == "known":
            keep = np.isin(self.codes, [ord(a) for a in args[1]]) & (_place(self.n) < self.own[self.owner])
            return self.array(args[0])[0][keep], np.bincount(self.owner[keep], minlength=self.rows)
        v, sizes = self.array(name)
        return v[_place(sizes) < np.repeat(self.own, sizes)], np.minimum(sizes, self.own)

    def _couplings(self, letters: str, lag: int) -> dict[tuple, np.ndarray]:
        """Pairs that begin in the blocks: the halo is no longer than the lag here."""
        whole = self.codes, self.n, self.owner
        keep = _place(self.n) < (self.own + lag)[self.owner]
        self.codes, self.n = self.codes[keep], np.minimum(self.n, self.own + lag)
        self.owner = _owner(self.n)
        try:
            return super()._couplings(letters, lag)
        finally:
            self.codes, self.n, self.owner = whole

    def _summed(self, name: str) -> list[pa.Array]:
        v, sizes = self.cut(name)
        none = sizes == 0
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = self.sums(v, sizes) / sizes
        out = [mean, self.sums((v - np.repeat(mean, sizes)) ** 2, sizes).astype(np.float64)]
        begin = (np.cumsum(sizes) - sizes)[~none]
        ends = [np.minimum.reduceat(v, begin), np.maximum.reduceat(v, begin), v[begin], v[begin + sizes[~none] - 1]] if len(v) else [np.zeros(0)] * 4
        for values in ends:
            whole = np.zeros(self.rows)
            whole[~none] = values
            out.append(whole)
        return [pa.array(sizes.astype(np.int64)), *(pa.array(x, mask=none) for x in out)]

    def _hits(self, name: str) -> np.ndarray:
        _, array, sign, value = self.recipes.figures[name]
        v, sizes = self.cut(array)
        return self.sums({"<": np.less, "<=": np.less_equal, ">": np.greater, ">=": np.greater_equal}[sign](v, value), sizes)

    def _runs(self, key: str, edges: list[tuple]) -> list[np.ndarray]:
        """(count, longest, residues in runs of two, of three and more) of the runs that touch no end; the others are added to ``edges``."""
        keep = _place(self.n) < self.own[self.owner]
        codes, owner = self.codes[keep].astype(np.int64), self.owner[keep]
        label = codes if key == "codes_lengths" else np.isin(codes, [ord(a) for a in key.removeprefix("runs_")]).astype(np.int64)
        opens = np.flatnonzero(np.r_[True, (label[1:] != label[:-1]) | (owner[1:] != owner[:-1])]) if len(label) else np.zeros(0, np.int64)
        closes = np.r_[opens[1:], len(label)] if len(opens) else opens
        opens, closes = opens[label[opens] > 0], closes[label[opens] > 0]
        of, begin = owner[opens], (np.cumsum(self.own) - self.own)[owner[opens]]
        first, last = opens - begin, closes - begin
        edge = (first == 0) | (last == self.own[of])
        at = self.at[of[edge]]
        edges.append((of[edge], np.full(int(edge.sum()), key), label[opens[edge]], at + first[edge], at + last[edge]))
        of, size = of[~edge], (last - first)[~edge]
        longest = np.zeros(self.rows, dtype=np.int64)
        np.maximum.at(longest, of, size)
        count = lambda weights: np.bincount(of, weights=weights, minlength=self.rows).astype(np.int64)
        return [count(np.ones(len(of))), longest, count(np.where(size > 1, size, 0)), count(np.where(size > 2, size, 0))]

    def _edges(self, edges: list[tuple]) -> pa.Array:
        if not edges:
            return pa.array([[]] * self.rows, pa.list_(_EDGE))
        of, *values = map(np.concatenate, zip(*edges, strict=True))
        order = np.argsort(of, kind="stable")
        offsets = pa.array(np.r_[0, np.cumsum(np.bincount(of, minlength=self.rows))].astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(v[order]).cast(f.type) for v, f in zip(values, _EDGE, strict=True)], fields=list(_EDGE)))

    def word_counts(self) -> Iterator[pa.RecordBatch]:
        """(id, k, word, count, first and last place) of the words that begin in the blocks, once for neighbouring blocks of one sequence."""
        ids = self.batch.column(0).to_pylist()
        run = np.maximum.accumulate([0, *(i if ids[i] != ids[i - 1] else 0 for i in range(1, self.rows))])
        for k in self.plan.words:
            v, sizes = self.words(k)
            owner, place = _owner(sizes), _place(sizes)
            keep = place < self.own[owner]
            v, owner, place = v[keep], owner[keep], place[keep]
            if not len(v):
                continue
            key = run[owner] * len(RESIDUES) ** k + v
            order = np.argsort(key, kind="stable")
            head = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
            at = (place + self.at[owner])[order]
            found = [v[order[head]], np.diff(np.r_[head, len(key)]), np.minimum.reduceat(at, head), np.maximum.reduceat(at, head)]
            yield pa.RecordBatch.from_arrays([self.batch.column(0).take(pa.array(run[owner[order[head]]])), pa.array(np.full(len(head), k, np.int32)), *map(pa.array, found)], names=["id", "k", "word", "c", "first", "last"])

    def state(self) -> pa.RecordBatch:
        reach, edges = self.plan.reach, []
        text = np.frombuffer(b"".join(self.text), dtype=np.uint8)
        letters = np.bincount(_owner(self.own) * 256 + text, minlength=self.rows * 256).reshape(self.rows, 256)
        out = [self.batch.column(0), self.batch.column(1), pa.array(self.own), pa.array(self.n > self.own)]
        out += [pa.array([t[:reach].decode() for t in self.text]), pa.array([t[-reach:].decode() if reach else "" for t in self.text])]
        out += [pa.array(letters[:, ord(a)].astype(np.int64)) for a in RESIDUES]
        for a in self.plan.arrays:
            out += self._summed(a)
        out += [pa.array(self._hits(k).astype(np.float64)) for k in self.plan.shares]
        out += [pa.array(self.couplings(*self.recipes.figures[k][1:3])[self.recipes.figures[k][3]]) for k in self.plan.pairs]
        for r in self.plan.runs:
            out += [pa.array(x) for x in self._runs(r, edges)]
        out.append(self._edges(edges))
        return pa.RecordBatch.from_arrays(out, names=[name for name, _ in self.plan.columns()])
