"""Complexity: entropy, repeated words and runs."""

from __future__ import annotations

import math

from ..functions.alphabet import GROUPS
from ..functions.dialect import Counts, Dialect
from .base import Descriptor, lengths, register
from .kinds import NUMBER, WHOLE
from .composition import gini

_PLACE = 2147483648  # 2 ** 31: a word's number times this, plus its place


def run_lengths(d: Dialect, array: str, size: str) -> str:
    """Lengths of the runs of equal neighbours in a named array."""
    starts = d.let(f"{array}_starts", f"CASE WHEN {size} > 0 THEN {d.filter(d.over('0', f'{size} - 1', f'CASE WHEN i = 0 OR {d.get(array, "i")} <> {d.get(array, "greatest(i - 1, 0)")} THEN i END'), 'x IS NOT NULL')} ELSE {d.empty('int')} END")
    count = d.let(f"{array}_runs", d.size(starts))
    return d.let(f"{array}_lengths", f"CASE WHEN {count} > 0 THEN {d.over('0', f'{count} - 1', f'CASE WHEN i + 1 < {count} THEN {d.get(starts, "i + 1")} ELSE {size} END - {d.get(starts, "i")}')} ELSE {d.empty('int')} END")


class Words:
    """The overlapping words of k residues and how often each occurs."""

    def __init__(self, d: Dialect, k: int) -> None:
        d.codes()
        self.d, self.k = d, k
        if d.vectors:
            self.words, self.size, self.total = d.let(f"words{k}", d.words(k)), self.figure("size"), self.figure("total")
            return
        self.words = d.let(f"words{k}", d.words(k))
        self.size = d.let(f"words{k}_size", d.size(self.words))
        self.order = d.let(f"words{k}_order", d.sorted(self.words))
        self.counts = run_lengths(d, self.order, self.size)
        self.repeated = d.let(f"words{k}_repeated", d.filter(self.counts, "x > 1"))
        self.total = d.let(f"words{k}_repeated_total", d.total(d.map(self.repeated, d.number(1) + " * x")))

    def some(self, sql: str) -> str:
        return self.d.where(f"{self.size} > 0", sql)

    def figure(self, which: str) -> str:
        return self.d.figure(f"words{self.k}_{which}_", "word_figure", self.k, which)

    def repeated_fraction(self) -> str:
        return self.d.ratio(self.total, self.size)

    def unique_fraction(self) -> str:
        return self.d.ratio(self.figure("kinds") if self.d.vectors else self.d.size(self.counts), self.size)

    def top(self) -> str:
        if self.d.vectors:
            return self.figure("top")
        return self.some(self.d.high(self.counts))

    def entropy(self) -> str:
        d = self.d
        if d.vectors:
            return self.figure("entropy")
        body = f"(x / {self.total}) * log2(x / {self.total})"
        return self.some(f"CASE WHEN {self.total} > 0 THEN 0 - {d.total(d.map(self.repeated, body))} ELSE 0 END")

    def concentration(self) -> str:
        if self.d.vectors:
            return self.figure("concentration")
        return self.some(f"CASE WHEN {self.total} > 0 THEN {self.d.high(self.repeated)} / {self.total} ELSE 0 END")

    def placed(self) -> str:
        """Word and place in one number, in order: all places of a word stand together."""
        d = self.d
        return d.let(f"words{self.k}_placed", d.sorted(d.mapi(self.words, f"x * {_PLACE} + i")))

    def span(self) -> str:
        """Mean distance from the first to the last place of the repeated words."""
        if self.d.vectors:
            return self.figure("span")
        d, placed = self.d, self.placed()
        starts, runs = f"{self.order}_starts", f"{self.order}_runs"
        last = f"{d.get(starts, 'i')} + {d.get(self.counts, 'i')} - 1"
        spans = d.over("0", f"{runs} - 1", f"CASE WHEN {d.get(self.counts, 'i')} > 1 THEN {d.number(1)} * ({d.get(placed, last)} - {d.get(placed, d.get(starts, 'i'))}) ELSE {d.number(0)} END")
        return d.let(f"words{self.k}_span", d.where(f"{self.total} > 0", f"{d.total(spans)} / {d.size(self.repeated)}"))

    def longest_block(self) -> str:
        """Longest run of places whose words are repeated."""
        if self.d.vectors:
            return self.figure("longest")
        d, placed = self.d, self.placed()
        word = lambda i: f"floor({d.get(placed, i)} / {d.number(_PLACE)})"
        same = f"(i > 0 AND {word('i')} = {word('greatest(i - 1, 0)')}) OR (i + 1 < {self.size} AND {word('i')} = {word(f'least(i + 1, {self.size} - 1)')})"
        body = f"CASE WHEN {same} THEN cast({d.get(placed, 'i')} - {word('i')} * {_PLACE} as bigint) END"
        places = d.let(f"words{self.k}_places", f"CASE WHEN {self.size} > 0 THEN {d.sorted(d.filter(d.over('0', f'{self.size} - 1', body), 'x IS NOT NULL'))} ELSE {d.empty('bigint')} END")
        islands = d.let(f"words{self.k}_islands", d.mapi(places, "x - i"))
        lengths_ = run_lengths(d, islands, d.let(f"words{self.k}_islands_size", d.size(islands)))
        return self.some(f"coalesce({d.high(lengths_)}, 0)")


def linguistic(d: Dialect, k: int) -> str:
    if d.vectors:
        return d.where(f"n >= {k}", f"{d.figure(f'words{k}_kinds_', 'word_figure', k, 'kinds')} / least(n - {k - 1}, {20**k})")
    w = d.let(f"words{k}", (d.codes(), d.words(k))[1])
    return d.where(f"n >= {k}", f"{d.distinct(w)} / {d.number(1)} / least(n - {k - 1}, {20**k})")


def window_entropies(d: Dialect, w: int) -> str:
    """Entropies of all windows of w residues: log2(w) less the mean log2 of how often each residue occurs in it."""
    codes = d.codes()
    counts = [" + ".join(["1"] + [f"CASE WHEN {d.get(codes, f'i + {j}')} = {d.get(codes, f'i + {k}')} THEN 1 ELSE 0 END" for k in range(w) if k != j]) for j in range(w)]
    logs = d.literal([0.0] + [math.log2(x) for x in range(1, w + 1)])
    body = f"greatest({d.number(0)}, {d.number(math.log2(w))} - (" + " + ".join(d.get(logs, c) for c in counts) + f") / {w})"
    return d.profile(f"window_entropy{w}", f"CASE WHEN n >= {w} THEN {d.over('0', f'n - {w}', body)} ELSE {d.empty('double')} END", "entropy", w)


def homopolymers(d: Dialect) -> str:
    return run_lengths(d, d.codes(), "n")


def how_many(d: Dialect, lengths_: str) -> str:
    return d.let(f"{lengths_}_count", d.size(lengths_))


def longest(d: Dialect, lengths_: str) -> str:
    return d.let(f"{lengths_}_longest", f"coalesce({d.high(lengths_)}, 0)")


def longest_homopolymer(d: Dialect) -> str:
    return longest(d, homopolymers(d))


def in_runs(d: Dialect, lengths_: str, least: int) -> str:
    return d.ratio(d.let(f"{lengths_}_in{least}", d.total(d.map(d.filter(lengths_, f"x >= {least}"), d.number(1) + " * x"))), "n")


@register("entropy_complexity", family="complexity", low_complexity_window=WHOLE, entropy_threshold=NUMBER)
class EntropyComplexity(Descriptor):
    """Entropy, linguistic complexity and low-complexity windows."""

    def __init__(self, *, low_complexity_window: int = 5, entropy_threshold: float = 1.5) -> None:
        self.low_complexity_window, self.entropy_threshold = low_complexity_window, entropy_threshold

    def features(self, d: Dialect) -> list[tuple[str, str]]:
        c, w = Counts(d), self.low_complexity_window
        rising, profile = c.fractions_sorted(), window_entropies(d, w)
        stats = dict(d.stats(profile, ("mean", "std")))
        out = [*lengths(), ("shannon_entropy", c.entropy()), ("shannon_entropy_norm", d.where("n > 1", f"{c.entropy()} / log2(least(n, 20))"))]
        out += [(f"linguistic_complexity_k{k}", linguistic(d, k)) for k in (1, 2, 3)]
        for k in (2, 3):
            words = Words(d, k)
            out += [(f"unique_kmer_fraction_k{k}", words.unique_fraction()), (f"repeated_kmer_fraction_k{k}", words.repeated_fraction())]
        runs = homopolymers(d)
        out += [("longest_homopolymer_run", longest_homopolymer(d)), ("homopolymer_burden_len2", in_runs(d, runs, 2)), ("homopolymer_burden_len3", in_runs(d, runs, 3))]
        out += [(f"low_complexity_window_fraction_w{w}", d.share(profile, f"x <= {d.number(self.entropy_threshold + 1e-12)}"))]
        out += [(f"window_entropy_mean_w{w}", stats["mean"]), (f"window_entropy_std_w{w}", stats["std"])]
        gap = f"CASE WHEN {d.get(rising, 18)} > 0 THEN {d.get(rising, 19)} - {d.get(rising, 18)} ELSE 1 END"
        return [*out, ("most_frequent_residue_fraction", d.where("n > 0", d.get(rising, 19))), ("gini_like_inequality", gini(d, c)), ("residue_dominance_gap", d.where("n > 0", gap))]


@register("local_repetition", family="complexity")
class LocalRepetition(Descriptor):
    """Repeated words: how many, how often, how far apart and how clustered."""

    def features(self, d: Dialect) -> list[tuple[str, str]]:
        w = {k: Words(d, k) for k in (2, 3, 4, 5, 6)}
        two = (2, 3)
        out = lengths()
        out += [(f"repeated_fraction_k{k}", w[k].repeated_fraction()) for k in (2, 3, 4)]
        out += [(f"unique_fraction_k{k}", w[k].unique_fraction()) for k in (2, 3, 4)]
        out += [(f"redundancy_score_k{k}", f"1 - {w[k].unique_fraction()}") for k in (2, 3, 4)]
        out += [(f"top_count_k{k}", w[k].top()) for k in two] + [(f"top_freq_k{k}", d.ratio(w[k].top(), w[k].size)) for k in two]
        out += [(f"duplicate_window_fraction_w{k}", w[k].repeated_fraction()) for k in (5, 6)]
        out += [(f"repeated_word_burden_k{k}", w[k].repeated_fraction()) for k in two]
        out += [(f"recurrence_entropy_k{k}", w[k].entropy()) for k in two]
        out += [(f"repeated_span_k{k}", w[k].span()) for k in two] + [(f"repeated_span_norm_k{k}", d.where("n > 0", f"{w[k].span()} / n")) for k in two]
        out += [(f"repeated_block_density_k{k}", w[k].repeated_fraction()) for k in two]
        out += [(f"longest_redundant_block_k{k}", w[k].longest_block()) for k in two]
        out += [(f"recurrence_concentration_k{k}", w[k].concentration()) for k in two]
        for outer in (8, 10):
            inner = outer - 1
            body = f"1 - {d.distinct(d.slice('words2', 'i + 1', str(inner)))} / {d.number(inner)}"
            profile = d.profile(f"redundancy{outer}", f"CASE WHEN n >= {outer} THEN {d.over('0', f'n - {outer}', body)} ELSE {d.empty('double')} END", "repeats", 2, inner)
            out += [(f"local_redundancy_{k}_w{outer}_k2", v) for k, v in d.stats(profile, ("mean", "std"))]
        return out


TRACKED = ("charged", "hydrophobic", "polar", "aromatic", "disorder_promoting", "order_promoting")


def group_runs(d: Dialect, group: str) -> str:
    """Lengths of the runs of a group's residues."""
    name = "".join(sorted(set(group)))
    return d.let(f"runs_{name}", d.map(d.matches("seq", f"[{name}]+"), "length(x)"))


def longest_run(d: Dialect, group: str) -> str:
    return longest(d, group_runs(d, group))


@register("run_blockiness", family="complexity")
class RunBlockiness(Descriptor):
    """Runs of one residue and of the residues of a group."""

    def features(self, d: Dialect) -> list[tuple[str, str]]:
        c, runs = Counts(d), homopolymers(d)
        out = [*lengths(), ("longest_homopolymer", longest_homopolymer(d)), ("homopolymer_run_density", d.ratio(how_many(d, runs), "n"))]
        out += [(f"repeated_block_fraction_len{k}", in_runs(d, runs, k)) for k in (2, 3)]
        for g in TRACKED:
            own, members = group_runs(d, GROUPS[g]), "".join(sorted(set(GROUPS[g])))
            count = how_many(d, own)
            ends = " - ".join(f"CASE WHEN instr('{members}', {side}(seq, 1)) > 0 THEN 1 ELSE 0 END" for side in ("left", "right"))
            switches = f"2 * {count} - {ends}"
            out += [(f"{g}_longest", longest_run(d, GROUPS[g])), (f"{g}_n_runs", count), (f"{g}_mean_run_length", d.ratio(c.count(members), count)), (f"{g}_longest_norm", d.ratio(longest_run(d, GROUPS[g]), "n")), (f"{g}_run_density", d.ratio(count, "n"))]
            out += [(f"{g}_fraction_in_runs_len{k}", in_runs(d, own, k)) for k in (2, 3)]
            out += [(f"{g}_blockiness", d.ratio("1", count)), (f"{g}_switching_freq", d.where("n > 1", f"({switches}) / {d.number(1)} / (n - 1)"))]
        return out
