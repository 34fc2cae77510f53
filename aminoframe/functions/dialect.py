"""Feature expressions as SQL text, for Spark and, as a check, for DuckDB.

Expressions are over a prepared row: ``seq`` (cleaned), ``n`` (its length) and shared intermediates.  An intermediate is
introduced by ``let``; each gets a level above those it uses, and the plan computes one projection per level, so an array
or a count is computed once however many features use it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

from .alphabet import RESIDUES
from .vectors import Recipes


class Dialect:
    """Spark SQL.  Arrays are 0-based in ``get``; lambda variables are plain names."""

    nan = "double('NaN')"
    #: Whether the plan has a stage for figures of profiles and words (``vectors``); otherwise they are SQL as well.
    vectors = True

    def __init__(self) -> None:
        self.recipes = Recipes()
        self.levels: dict[str, int] = {"seq": 0, "n": 0}
        self.lets: dict[str, str] = {}
        self.spelled: dict[str, str] = {}

    @staticmethod
    def key(*parts: object) -> str:
        """A part of an intermediate's name that stands for a user's names and values, whatever signs they hold."""
        return hashlib.sha256(repr(parts).encode()).hexdigest()[:16]

    def let(self, name: str, sql: str) -> str:
        """Names an intermediate, for all descriptors of a plan; one name can't stand for two expressions."""
        taken = self.spelled.setdefault(name.lower(), name)
        if taken != name or self.lets.get(name, sql) != sql or name in ("seq", "n"):
            raise ValueError(f"an intermediate {taken!r} of another expression is there already; choose a name of its own for {name!r}")
        if name not in self.lets:
            used = [self.levels[w] for w in set(re.findall(r"[A-Za-z_]\w*", sql)) if w in self.levels]
            self.lets[name], self.levels[name] = sql, 1 + max(used, default=0)
        return name

    def profile(self, name: str, sql: str, *recipe: object) -> str:
        """Names an array that the vector stage can make too."""
        self.recipes.arrays[self.let(name, sql)] = recipe
        return name

    def array(self, name: str, *recipe: object) -> str:
        """Names an array of the vector stage; its statistics are figures."""
        if self.recipes.arrays.setdefault(name, recipe) != recipe:
            raise ValueError(f"{name!r} is another array already")
        return name

    def figure(self, name: str, *what: object) -> str:
        """A column of the vector stage."""
        if self.recipes.figures.setdefault(name, what) != what:
            raise ValueError(f"{name!r} is another figure already")
        return name

    def stages(self) -> list[list[tuple[str, str]]]:
        top = max((self.levels[name] for name in self.lets), default=0)
        return [[(name, sql) for name, sql in self.lets.items() if self.levels[name] == level] for level in range(1, top + 1)]

    # Differences between the two systems.
    def get(self, array: str, i: str | int) -> str:
        return f"get({array}, {i})"

    def map(self, array: str, body: str, x: str = "x") -> str:
        return f"transform({array}, {x} -> {body})"

    def mapi(self, array: str, body: str) -> str:
        """``x`` is the element, ``i`` its 0-based place."""
        return f"transform({array}, (x, i) -> {body})"

    def filter(self, array: str, body: str, x: str = "x") -> str:
        return f"filter({array}, {x} -> {body})"

    def total(self, array: str) -> str:
        """0 for an empty array."""
        return f"aggregate({array}, 0D, (a, x) -> a + x)"

    def over(self, lo: str, hi: str, body: str) -> str:
        """``body`` for i = lo .. hi; hi >= lo."""
        return f"transform(sequence({lo}, {hi}), i -> {body})"

    def low(self, array: str) -> str:
        return f"array_min({array})"

    def high(self, array: str) -> str:
        return f"array_max({array})"

    def sorted(self, array: str) -> str:
        return f"sort_array({array})"

    def empty(self, kind: str) -> str:
        return f"cast(array() as array<{kind}>)"

    def size(self, array: str) -> str:
        return f"size({array})"

    def distinct(self, array: str) -> str:
        return f"size(array_distinct({array}))"

    def literal(self, values: Iterable[float]) -> str:
        return "array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")"

    def letters(self, seq: str) -> str:
        """Places of the letters in the alphabet, from 0 (A) to 25 (Z)."""
        return f"transform(filter(split({seq}, ''), x -> x <> ''), x -> ascii(x) - 65)"

    def words(self, k: int) -> str:
        """All overlapping words of k letters, as numbers."""
        body = " + ".join(f"{self.get('codes', f'i + {j}' if j else 'i')} * {26 ** (k - 1 - j)}L" for j in range(k))
        return f"CASE WHEN n >= {k} THEN {self.over('0', f'n - {k}', body)} ELSE {self.empty('bigint')} END"

    def matches(self, text: str, pattern: str) -> str:
        return f"regexp_extract_all({text}, {self.text(pattern)}, 0)"

    def parts(self, text: str, pattern: str) -> str:
        return f"split({text}, {self.text(pattern)}, -1)"

    def text(self, value: str) -> str:
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def found(self, text: str, pattern: str) -> str:
        return f"{text} rlike {self.text(pattern)}"

    def slice(self, array: str, start: str, length: str) -> str:
        """``start`` counts from 1."""
        return f"slice({array}, {start}, {length})"

    # The same for both.
    def ratio(self, a: str, b: str) -> str:
        return f"CASE WHEN ({b}) <> 0 THEN ({a}) / ({b}) ELSE {self.nan} END"

    def where(self, condition: str, value: str) -> str:
        return f"CASE WHEN {condition} THEN {value} ELSE {self.nan} END"

    def number(self, value: float) -> str:
        return f"cast({float(value)!r} as double)" if "e" in repr(float(value)) else f"double({float(value)!r})"

    def codes(self) -> str:
        return self.let("codes", self.letters("seq"))

    def values(self, name: str, scale: dict[str, float]) -> str:
        """The scale's value of every residue; ``scale`` covers all residues."""
        table = [scale.get(chr(65 + i), 0.0) for i in range(26)]
        return self.profile(f"v_{name}", self.map(self.codes(), self.get(self.literal(table), "x")), "scale", tuple(table))

    def mask(self, group: str) -> str:
        """1 or 0 for every residue."""
        return self.values("in_" + self.members(group), {r: 1.0 for r in group})

    def members(self, group: str) -> str:
        """A name for a group of residues: its letters, or a key if it has other signs."""
        letters = "".join(sorted(set(group)))
        return letters if letters.isalpha() and letters.isascii() and letters.isupper() else self.key(letters)

    def places(self, group: str) -> str:
        """1-based positions of the group's residues."""
        name = self.members(group)
        body = self.mapi(self.mask(group), "CASE WHEN x > 0 THEN i + 1 END")
        return self.let(f"pos_{name}", self.filter(body, "x IS NOT NULL"))

    def rolling(self, array: str, w: int) -> str:
        """Means of all windows of w values, summed from the left as value / w terms."""
        terms = " + ".join(f"{self.get(array, f'i + {j}' if j else 'i')} * {self.number(1.0 / w)}" for j in range(w))
        return self.profile(f"roll{w}_{array}", f"CASE WHEN n >= {w} THEN {self.over('0', f'n - {w}', terms)} ELSE {self.empty('double')} END", "roll", array, w)

    def stats(self, array: str, which: tuple[str, ...] = ("mean", "std", "min", "max", "amplitude", "start_end_diff")) -> list[tuple[str, str]]:
        """Statistics of a named array; NaN for an empty one."""
        if self.vectors and array in self.recipes.arrays:
            return [(k, self.figure(f"{array}_{k}_", "stat", array, k)) for k in which]
        size = self.let(f"{array}_size", self.size(array))
        mean = self.let(f"{array}_mean", self.ratio(self.total(array), size))
        square = self.map(array, f"(y - {mean}) * (y - {mean})", "y")
        out = {"mean": mean}
        if "std" in which:
            out["std"] = self.let(f"{array}_std", f"CASE WHEN {size} > 0 THEN sqrt({self.total(square)} / {size}) ELSE {self.nan} END")
        low, high = self.let(f"{array}_low", f"coalesce({self.low(array)}, {self.nan})"), self.let(f"{array}_high", f"coalesce({self.high(array)}, {self.nan})")
        out |= {"min": low, "max": high, "amplitude": f"{high} - {low}"}
        out["start_end_diff"] = self.where(f"{size} > 0", f"{self.get(array, f'{size} - 1')} - {self.get(array, 0)}")
        return [(k, out[k]) for k in which]

    def share(self, array: str, condition: str) -> str:
        """Share of a named array's values ``x`` that meet a condition."""
        if self.vectors and array in self.recipes.arrays:
            _, sign, value = condition.split()
            value = float(re.search(r"-?[\d.]+(?:e[-+]?\d+)?", value)[0])
            return self.figure(f"{array}_share_{self.key(sign, value)}", "share", array, sign, value)
        return self.ratio(self.size(self.filter(array, condition)), self.size(array))

    def coupled(self, letters: str, lag: int, kind: str, *args: object) -> str:
        """Sum of weights over the residue pairs at a lag (``vectors``); residues other than ``letters`` are left out first."""
        return self.figure(f"pairs{lag}_{self.key(letters, kind, args)}", "coupled", letters, lag, (kind, *args))

    def median(self, array: str) -> str:
        """Of a named array of numbers."""
        if self.vectors and array in self.recipes.arrays:
            return self.figure(f"{array}_median_", "median", array)
        order = self.let(f"{array}_order", self.sorted(array))
        size = self.let(f"{array}_size", self.size(array))
        middle = [self.get(order, f"cast(floor(({size} - {j}) / 2.0) as int)") for j in (1, 0)]
        return self.where(f"{size} > 0", f"({middle[0]} + {middle[1]}) / 2.0")


class DuckDb(Dialect):
    """The same in DuckDB's SQL."""

    nan = "'NaN'::DOUBLE"
    vectors = False

    def get(self, array: str, i: str | int) -> str:
        return f"{array}[({i}) + 1]"

    def map(self, array: str, body: str, x: str = "x") -> str:
        return f"list_transform({array}, lambda {x}: {body})"

    def mapi(self, array: str, body: str) -> str:
        return f"list_transform({array}, lambda x, i1: {re.sub(r'\bi\b', '(i1 - 1)', body)})"

    def filter(self, array: str, body: str, x: str = "x") -> str:
        return f"list_filter({array}, lambda {x}: {body})"

    def total(self, array: str) -> str:
        return f"coalesce(list_sum({array}), 0)::DOUBLE"

    def over(self, lo: str, hi: str, body: str) -> str:
        return f"list_transform(range({lo}, ({hi}) + 1), lambda i: {body})"

    def low(self, array: str) -> str:
        return f"list_min({array})"

    def high(self, array: str) -> str:
        return f"list_max({array})"

    def sorted(self, array: str) -> str:
        return f"list_sort({array})"

    def empty(self, kind: str) -> str:
        return f"[]::{kind}[]"

    def size(self, array: str) -> str:
        return f"len({array})"

    def distinct(self, array: str) -> str:
        return f"len(list_distinct({array}))"

    def literal(self, values: Iterable[float]) -> str:
        return "[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in values) + "]"

    def letters(self, seq: str) -> str:
        return f"list_transform(range(1, len({seq}) + 1), lambda x: ascii({seq}[x]) - 65)"

    def matches(self, text: str, pattern: str) -> str:
        return f"regexp_extract_all({text}, {self.text(pattern)})"

    def parts(self, text: str, pattern: str) -> str:
        return f"string_split_regex({text}, {self.text(pattern)})"

    def text(self, value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    def found(self, text: str, pattern: str) -> str:
        return f"regexp_matches({text}, {self.text(pattern)})"

    def slice(self, array: str, start: str, length: str) -> str:
        return f"list_slice({array}, {start}, {start} + {length} - 1)"

    def number(self, value: float) -> str:
        return f"{float(value)!r}::DOUBLE"

    def words(self, k: int) -> str:
        return super().words(k).replace("L ", " ").replace("L E", " E").replace("L)", ")")


class Counts:
    """The 20 residue counts of a text column, and what follows from counts alone."""

    def __init__(self, d: Dialect, text: str = "seq", length: str = "n") -> None:
        self.d, self.text, self.n = d, text, length
        self.of = {a: d.let(f"count_{text}_{a}", f"length({text}) - length(replace({text}, '{a}', ''))") for a in RESIDUES}

    def count(self, group: str) -> str:
        return "(" + " + ".join(self.of[a] for a in sorted(set(group))) + ")"

    def fraction(self, group: str) -> str:
        return self.d.ratio(self.count(group), self.n)

    def mean(self, name: str, scale: dict[str, float]) -> str:
        d = self.d
        weighted = " + ".join(f"{self.of[a]} * {d.number(v)}" for a, v in sorted(scale.items()) if v) or d.number(0)
        return d.let(f"mean_{self.text}_{name}", d.ratio(weighted, self.n))

    def std(self, name: str, scale: dict[str, float]) -> str:
        d, mean = self.d, self.mean(name, scale)
        square = " + ".join(f"{self.of[a]} * ({d.number(v)} - {mean}) * ({d.number(v)} - {mean})" for a, v in sorted(scale.items()))
        return d.where(f"{self.n} > 0", f"sqrt(({square}) / {self.n})")

    def varied(self, scale: dict[str, float]) -> str:
        """Whether residues with different values of a scale occur."""
        alike: dict[float, list[str]] = {}
        for a, v in scale.items():
            alike.setdefault(v, []).append(a)
        return "(" + " + ".join(f"CASE WHEN {self.count(''.join(letters))} > 0 THEN 1 ELSE 0 END" for letters in alike.values()) + ") > 1"

    def entropy(self) -> str:
        d = self.d
        terms = " + ".join(f"CASE WHEN {c} > 0 THEN ({c} / {d.number(1)} / {self.n}) * log2({c} / {d.number(1)} / {self.n}) ELSE 0 END" for c in self.of.values())
        return d.let(f"entropy_{self.text}", d.where(f"{self.n} > 0", f"0 - ({terms})"))

    def net_charge(self, ph: float) -> str:
        """Henderson-Hasselbalch charge of the residues and both ends; NaN for an empty text."""
        from .charge import end_charge, residue_charge

        d = self.d
        terms = " + ".join(f"{self.of[a]} * {d.number(q)}" for a, q in sorted(residue_charge(ph).items()))
        return d.where(f"{self.n} > 0", f"{d.number(end_charge(ph))} + {terms}")

    def fractions_sorted(self) -> str:
        """All 20 fractions in rising order, for a text that isn't empty."""
        d = self.d
        make = "array" if type(d) is Dialect else "list_value"
        return d.let(f"fractions_{self.text}", f"CASE WHEN {self.n} > 0 THEN {d.sorted(make + '(' + ', '.join(f'{c} / {d.number(1)} / {self.n}' for c in self.of.values()) + ')')} END")


def segment(d: Dialect, side: str, w: int) -> Counts:
    """Counts of the first ("n") or last ("c") w residues; a last segment of 0 is the whole sequence."""
    text = d.let(f"{side}seg{w}", f"left(seq, {w})" if side == "n" else "seq" if w == 0 else f"right(seq, {w})")
    return Counts(d, text, d.let(f"{text}_n", f"length({text})"))
