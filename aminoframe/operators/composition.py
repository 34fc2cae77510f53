"""Composition: residues, words, groups and their bias."""

from __future__ import annotations

import warnings
from itertools import product

from ..functions.alphabet import GROUPS, RESIDUES
from ..functions.dialect import Counts, Dialect
from .base import Descriptor, lengths, register
from .kinds import FLAG, WHOLE, ParameterError


def _unique(c: Counts) -> str:
    return " + ".join(f"CASE WHEN {x} > 0 THEN 1 ELSE 0 END" for x in c.of.values())


@register("aac", family="composition", include_counts=FLAG, include_frequencies=FLAG)
class ResidueComposition(Descriptor):
    """Counts and fractions of the 20 residues."""

    def __init__(self, *, include_counts: bool = True, include_frequencies: bool = True) -> None:
        self.include_counts, self.include_frequencies = include_counts, include_frequencies

    def features(self, d: Dialect) -> list[tuple[str, str]]:
        c = Counts(d)
        out = [*lengths(), ("unique_residue_count", _unique(c))]
        if self.include_counts:
            out += [(f"count_{a}", c.of[a]) for a in RESIDUES]
        if self.include_frequencies:
            out += [(f"freq_{a}", c.fraction(a)) for a in RESIDUES]
            out.append(("frequency_sum", d.ratio(c.count(RESIDUES), "n")))
        return out


def _word_features(d: Dialect, k: int, counts: bool, frequencies: bool, total: str, unique: str) -> list[tuple[str, str]]:
    """Counts of all words of k residues, from a table of the vector stage.

    In SQL, removing a word from the text counts it, if no two of its places can overlap; words that can overlap themselves are
    counted in the array of all words.
    """
    names = ["".join(p) for p in product(RESIDUES, repeat=k)]
    of = {}
    if d.vectors:
        size, kinds = (d.figure(f"words{k}_{x}_", "word_figure", k, x) for x in ("size", "kinds"))
        table = d.figure(f"words{k}_table", "table", k)
        of = {w: d.get(table, i) for i, w in enumerate(names)}
    else:
        words = d.let(f"words{k}", (d.codes(), d.words(k))[1])
        size, kinds = d.let(f"words{k}_size", d.size(words)), d.distinct(words)
    out = [(total, size), (unique, kinds)]
    for w in names if not of else ():
        if any(w[:i] == w[-i:] for i in range(1, k)):
            number = sum((ord(ch) - 65) * 26 ** (k - 1 - j) for j, ch in enumerate(w))
            of[w] = d.let(f"word_{w}", d.size(d.filter(words, f"x = {number}")))
        else:
            of[w] = d.let(f"word_{w}", f"cast((n - length(replace(seq, '{w}', ''))) / {k} as int)")
    if counts:
        out += [(f"count_{w}", of[w]) for w in names]
    if frequencies:
        out += [(f"freq_{w}", d.ratio(of[w], size)) for w in names]
        out.append(("frequency_sum", d.ratio(size, size)))
    return out


@register("dpc", family="composition", include_counts=FLAG, include_frequencies=FLAG)
class DipeptideComposition(Descriptor):
    """Counts and fractions of the 400 residue pairs."""

    def __init__(self, *, include_counts: bool = True, include_frequencies: bool = True) -> None:
        self.include_counts, self.include_frequencies = include_counts, include_frequencies

    def features(self, d: Dialect) -> list[tuple[str, str]]:
        return lengths() + _word_features(d, 2, self.include_counts, self.include_frequencies, "total_dipeptides", "unique_dipeptides")


@register("kmer_full_alphabet", family="composition", k=WHOLE, include_counts=FLAG, include_frequencies=FLAG)
class WordComposition(Descriptor):
    """Counts and fractions of all words of k residues."""

    def __init__(self, *, k: int = 2, include_counts: bool = True, include_frequencies: bool = True) -> None:
        if k < 1:
            raise ParameterError("k", "k must be 1 or more")
        if k >= 4:
            warnings.warn(f"k={k} makes {20**k} words; kmer_maps() has the same counts in a map, long_kmers() as rows", UserWarning, stacklevel=2)
        self.k, self.include_counts, self.include_frequencies = k, include_counts, include_frequencies

    def features(self, d: Dialect) -> list[tuple[str, str]]:
        return [("length", "n"), *_word_features(d, self.k, self.include_counts, self.include_frequencies, "total_kmers", "unique_kmers")]


@register("grouped", family="composition")
class GroupComposition(Descriptor):
    """Counts and fractions of the residue groups, and four ratios."""

    def features(self, d: Dialect) -> list[tuple[str, str]]:
        c = Counts(d)
        out = [("length", "n")]
        for g, members in GROUPS.items():
            out += [(f"{g}_count", c.count(members)), (f"{g}_frac", c.fraction(members))]
        acid, base, polar, nonpolar, charged = (c.count(GROUPS[g]) for g in ("negative", "positive", "polar", "nonpolar", "charged"))
        out += [("ratio_acidic_basic", d.ratio(acid, base)), ("ratio_basic_acidic", d.ratio(base, acid))]
        return [*out, ("ratio_polar_nonpolar", d.ratio(polar, nonpolar)), ("ratio_charged_uncharged", d.ratio(charged, f"n - {charged}"))]


_BIAS_PAIRS = (("positive", "negative"), ("hydrophobic", "hydrophilic"), ("polar", "nonpolar"), ("disorder_promoting", "order_promoting"))


def gini(d: Dialect, c: Counts) -> str:
    """Inequality of the 20 fractions; 0 if they are equal."""
    rising = c.fractions_sorted()
    weighted = " + ".join(f"{2 * (i + 1)} * {d.get(rising, i)}" for i in range(20))
    return d.where(f"{c.n} > 0", f"({weighted}) / 20 - {d.number(21 / 20)}")


@register("compositional_bias", family="composition")
class CompositionalBias(Descriptor):
    """How unevenly the residues and opposed groups are used."""

    def features(self, d: Dialect) -> list[tuple[str, str]]:
        c = Counts(d)
        rising = c.fractions_sorted()
        at = lambda i: d.get(rising, i)
        some = lambda sql: d.where("n > 0", sql)
        uniform = d.number(1 / 20)
        var = d.let("usage_var", some("(" + " + ".join(f"({c.fraction(a)} - {uniform}) * ({c.fraction(a)} - {uniform})" for a in RESIDUES) + ") / 20"))
        top = {k: some(" + ".join(at(19 - i) for i in range(k))) for k in (2, 3, 5)}
        kl = " + ".join(f"CASE WHEN {x} > 0 THEN {c.fraction(a)} * log2({c.fraction(a)} * 20) ELSE 0 END" for a, x in c.of.items())
        out = [*lengths(), ("usage_mean", some(uniform)), ("usage_std", f"sqrt({var})"), ("usage_var", var), ("usage_cv", f"sqrt({var}) * 20")]
        out += [("max_residue_fraction", some(at(19))), ("min_residue_fraction", some(at(0)))]
        out += [(f"top{k}_burden", top[k]) for k in (2, 3, 5)]
        out += [("dominance_gap", some(f"{at(19)} - {at(18)}")), ("gini_like_inequality", gini(d, c)), ("kl_div_uniform", some(kl))]
        out.append(("l1_dev_uniform", some(" + ".join(f"abs({c.fraction(a)} - {uniform})" for a in RESIDUES))))
        for a, b in _BIAS_PAIRS:
            fa, fb = c.fraction(GROUPS[a]), c.fraction(GROUPS[b])
            out += [(f"{a}_{b}_skew", f"{fa} - {fb}"), (f"{a}_{b}_ratio", d.ratio(c.count(GROUPS[a]), c.count(GROUPS[b])))]
        return out
