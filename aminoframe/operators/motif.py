"""Motifs: patterns, spacing and functional residues."""

from __future__ import annotations

import re
from collections.abc import Mapping

from ..functions.alphabet import ACCEPTORS, DONORS, GROUPS
from ..functions.dialect import Counts, Dialect, segment
from ..functions.patterns import for_java
from .base import Descriptor, lengths, register
from .ctd import TRACKED
from .kinds import FLAG, TEXT, WHOLE, ParameterError, maybe, named

# The default patterns and groups.
PATTERNS = {
    "CxxC": "C.{2}C",
    "PxxP": "P.{2}P",
    "polyK_3plus": "K{3,}",
    "polyR_3plus": "R{3,}",
    "acidic_patch_3plus": "[DE]{3,}",
    "basic_patch_3plus": "[KRH]{3,}",
    "gly_rich_4plus": "(?:G.*){4,}",
    "proline_rich_4plus": "(?:P.*){4,}",
    "ser_thr_rich_4plus": "(?:[ST].*){4,}",
}
USER_PATTERNS = {
    "basic_pair": "KR|RK|KK|RR",
    "acidic_pair": "DE|ED|DD|EE",
    "gly_run_2plus": "G{2,}",
    "pro_run_2plus": "P{2,}",
    "ser_thr_patch": "[ST]{3,}",
    "charged_triplet": "[KRHDE]{3,}",
    "aromatic_pair": "[FWYH]{2,}",
    "amide_pair": "[NQ]{2,}",
}
FUNCTIONAL = {
    "catalytic_core_like": "HSCDEKRY",
    "catalytic_nucleophilic": "SCYTK",
    "acid_base_active": "HDEKRY",
    "redox_sensitive": "CMYH",
    "sulfur_containing": "CM",
    "aromatic_pi": "FWYH",
    "hydroxyl_bearing": "STY",
    "amide_containing": "NQ",
    "flexibility_related": "GP",
    "basic_functional": "KRH",
    "acidic_functional": "DE",
    "phosphorylation_prone_proxy": "STY",
    "metal_binding_like": "HCDE",
    "nucleic_acid_binding_like": "KRH",
    "interface_like_aromatic_basic": "FWYHKR",
    "small_reactive": "GACS",
}
SINGLE = "HCSDEKRYWGTPNQM"
COMPOSITES = {
    "his_cys_ser_fraction": "HCS",
    "asp_glu_his_fraction": "DEH",
    "lys_arg_his_fraction": "KRH",
    "triad_like_fraction": "HSD",
    "redox_phospho_overlap_fraction": "CYT",
    "aromatic_basic_fraction": "FWYHKR",
    "gly_pro_fraction": "GP",
}
CROSS = {
    "positive_negative_cross_mean": ("positive", "negative"),
    "charged_hydrophobic_cross_mean": ("charged", "hydrophobic"),
    "aromatic_polar_cross_mean": ("aromatic", "polar"),
    "disorder_order_cross_mean": ("disorder_promoting", "order_promoting"),
}
_AT_LEAST = re.compile(r"\(\?:(\[[A-Z]+\]|[A-Z])\.\*\)\{(\d+),\}")


def _checked(pattern: str) -> None:
    try:
        re.compile(pattern)
    except re.error as e:
        raise ParameterError("patterns", f"{pattern!r}: {e}") from e


def _count(d: Dialect, text: str, pattern: str, end: tuple[str, int] | None = None) -> str:
    """Matches that don't overlap.  "At least m of these letters, whatever lies between" runs to the end: one match.

    Of a pattern that only Python can run, the vector stage counts; ``end``: in the first ("n") or last ("c") residues.
    """
    if m := _AT_LEAST.fullmatch(pattern):
        letters = m[1].strip("[]")
        total = " + ".join(f"(length({text}) - length(replace({text}, '{a}', '')))" for a in sorted(set(letters)))
        return f"CASE WHEN {total} >= {m[2]} THEN 1 ELSE 0 END"
    if (java := for_java(pattern)) is None:
        return d.figure(f"python_{d.key(pattern, end)}_count", "searched", pattern, False, end, "count")
    return d.size(d.matches(text, java))


def _yes(sql: str) -> str:
    return f"CASE WHEN {sql} > 0 THEN 1 ELSE 0 END"


@register("pattern", family="motif", patterns=maybe(named(TEXT)), include_terminal=FLAG, terminal_window=WHOLE)
class Pattern(Descriptor):
    """Presence, number and density of patterns, in all and at both ends."""

    def __init__(self, *, patterns: Mapping[str, str] | None = None, include_terminal: bool = True, terminal_window: int = 10) -> None:
        self.patterns, self.include_terminal, self.terminal_window = patterns or PATTERNS, include_terminal, terminal_window
        for p in self.patterns.values():
            _checked(p)

    def features(self, d: Dialect) -> list[tuple[str, str]]:
        out, w = lengths(), self.terminal_window
        for name, p in self.patterns.items():
            count = d.let(f"pattern_{d.key(p)}", _count(d, "seq", p))
            out += [(f"{name}_present", _yes(count)), (f"{name}_count", count), (f"{name}_density", d.ratio(count, "n"))]
            if self.include_terminal:
                out += [(f"{name}_{side}term_present_w{w}", _yes(_count(d, segment(d, side, w).text, p, (side, w)))) for side in "nc"]
        return out


@register("user_regex", family="motif", patterns=maybe(named(TEXT)), overlapping=FLAG, include_terminal=FLAG, terminal_window=WHOLE)
class UserRegex(Descriptor):
    """Number, places and span of a user's patterns; with ``overlapping`` a match may start inside another.

    Patterns are Python's.  Java runs those that mean the same there, Python the others, batch by batch.
    """

    def __init__(self, *, patterns: Mapping[str, str] | None = None, overlapping: bool = False, include_terminal: bool = True, terminal_window: int = 10) -> None:
        self.patterns, self.overlapping = patterns or USER_PATTERNS, overlapping
        self.include_terminal, self.terminal_window = include_terminal, terminal_window
        for p in self.patterns.values():
            _checked(p)

    def features(self, d: Dialect) -> list[tuple[str, str]]:
        out, w = lengths(), self.terminal_window
        for name, python in self.patterns.items():
            p, tag = for_java(python), d.key(python, self.overlapping)
            if p is None:
                count, first, last = (d.figure(f"python_{tag}_{k}", "searched", python, self.overlapping, None, k) for k in ("count", "first", "last"))
            elif self.overlapping:
                ahead = f"(?=(?:{p}))"
                count = d.let(f"regex_{tag}", f"size(regexp_extract_all(seq, {d.text(ahead)}, 0))")
                first = d.let(f"regex_{tag}_first", d.where(f"{count} > 0", f"regexp_instr(seq, {d.text(ahead)})"))
                last = d.let(f"regex_{tag}_last", d.where(f"{count} > 0", f"length(regexp_extract(seq, {d.text('^.*' + ahead)}, 0)) + 1"))
            else:
                found, parts = d.let(f"regex_{tag}_found", d.matches("seq", p)), d.let(f"regex_{tag}_parts", d.parts("seq", p))
                count = d.let(f"regex_{tag}", d.size(found))
                first = d.let(f"regex_{tag}_first", d.where(f"{count} > 0", f"length({d.get(parts, 0)}) + 1"))
                tail = f"length({d.get(found, f'greatest({count} - 1, 0)')}) - length({d.get(parts, f'{d.size(parts)} - 1')})"
                last = d.let(f"regex_{tag}_last", d.where(f"{count} > 0", f"n - {tail} + 1"))
            span = d.where(f"{count} > 1", f"{last} - {first}")
            out += [(f"{name}_present", _yes(count)), (f"{name}_count", count), (f"{name}_density", d.ratio(count, "n"))]
            out += [(f"{name}_first_pos", first), (f"{name}_last_pos", last), (f"{name}_first_pos_norm", d.ratio(first, "n")), (f"{name}_last_pos_norm", d.ratio(last, "n"))]
            out += [(f"{name}_span", span), (f"{name}_span_norm", d.where("n > 0", f"({span}) / n"))]
            if self.include_terminal:
                out += [(f"{name}_{side}term_present_w{w}", _yes(_count(d, segment(d, side, w).text, python, (side, w))) if p is None else f"CASE WHEN {d.found(segment(d, side, w).text, p)} THEN 1 ELSE 0 END") for side in "nc"]
        return out


@register("spacing", family="motif")
class Spacing(Descriptor):
    """Distances between neighbouring residues of a group, and to the nearest residue of another group."""

    def features(self, d: Dialect) -> list[tuple[str, str]]:
        c, out = Counts(d), lengths()
        for g, members in TRACKED.items():
            name = "".join(sorted(set(members)))
            places = d.array(f"places_{name}", "places", name)
            gaps, near = d.array(f"gaps_{name}", "gaps", places), d.array(f"near_{name}", "near", places)
            s, t = dict(d.stats(gaps, ("mean", "std", "min", "max"))), dict(d.stats(near, ("mean", "min", "max")))
            count, median = c.count(name), d.median(gaps)
            span = d.where(f"{count} > 1", dict(d.stats(places, ("amplitude",)))["amplitude"])
            out += [(f"{g}_count", count), (f"{g}_density", d.ratio(count, "n")), (f"{g}_span", span), (f"{g}_span_norm", d.where("n > 0", f"({span}) / n"))]
            out += [(f"{g}_mean", s["mean"]), (f"{g}_median", median), (f"{g}_min", s["min"]), (f"{g}_max", s["max"]), (f"{g}_std", s["std"])]
            out += [(f"{g}_{k}_norm", d.where("n > 0", f"{v} / n")) for k, v in (("mean", s["mean"]), ("median", median), ("max", s["max"]))]
            out += [(f"{g}_nn_mean", t["mean"]), (f"{g}_nn_median", d.median(near)), (f"{g}_nn_min", t["min"]), (f"{g}_nn_max", t["max"])]
        return out + [(name, d.figure(name, "nearest", GROUPS[a], GROUPS[b])) for name, (a, b) in CROSS.items()]


@register("functional_residue_content", family="motif")
class FunctionalResidues(Descriptor):
    """Counts and fractions of functional groups and single residues."""

    def features(self, d: Dialect) -> list[tuple[str, str]]:
        c, out = Counts(d), lengths()
        for name, members in [*FUNCTIONAL.items(), *((a, a) for a in SINGLE)]:
            out += [(f"{name}_count", c.count(members)), (f"{name}_fraction", c.fraction(members))]
        out += [(name, c.fraction(members)) for name, members in COMPOSITES.items()]
        for name, a, b in (("basic_acidic", "KRH", "DE"), ("aromatic_sulfur", "FWYH", "CM"), ("hydroxyl_amide", "STY", "NQ"), ("cys_met", "C", "M")):
            out.append((f"{name}_ratio", d.ratio(c.count(a), c.count(b))))
        donors, acceptors = c.fraction(DONORS), c.fraction(ACCEPTORS)
        return [*out, ("hbond_donors_per_residue", donors), ("hbond_acceptors_per_residue", acceptors), ("hbond_balance", f"{donors} - {acceptors}")]
