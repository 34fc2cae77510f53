"""Composition, transition and distribution."""

from __future__ import annotations

from collections.abc import Mapping

from ..functions.alphabet import GROUPS
from ..functions.dialect import Dialect
from .base import Descriptor, lengths, register
from .kinds import TEXT, ParameterError, maybe, named, several

# The three classes of each property.
CLASSES = {
    "hydrophobicity": {"1": "RKEDQN", "2": "GASTPHY", "3": "CLVIMFW"},
    "polarity": {"1": "LIFWCMVY", "2": "PATGS", "3": "HQRKNED"},
    "charge": {"1": "KR", "2": "ANCQGHILMFPSTWYV", "3": "DE"},
}
_POINTS = {"001": 0.0, "025": 0.25, "050": 0.5, "075": 0.75, "100": 1.0}


@register("ctd_classic", family="ctd", properties=several(TEXT), ctd_groups=maybe(named(named(TEXT))))
class CtdClassic(Descriptor):
    """Shares of three classes, changes between them, and where each class's members stand."""

    def __init__(self, *, properties: tuple[str, ...] = tuple(CLASSES), ctd_groups: Mapping[str, Mapping[str, str]] | None = None) -> None:
        self.properties, self.groups = tuple(properties), ctd_groups or CLASSES
        if unknown := [p for p in self.properties if p not in self.groups]:
            raise ParameterError("properties", f"properties without classes: {unknown}")

    def features(self, d: Dialect) -> list[tuple[str, str]]:
        out = lengths()
        for prop in self.properties:
            table: dict[str, float] = {}
            for number, members in self.groups[prop].items():
                for r in members:
                    table.setdefault(r, float(int(number)))
            tag = d.key(sorted(table.items()))
            labels = d.let(f"labels_{tag}", d.filter(d.values(f"class_{tag}", table), "x > 0"))
            size = d.let(f"labels_{tag}_size", d.size(labels))
            pairs = d.let(f"changes_{tag}", f"CASE WHEN {size} > 1 THEN {d.over('0', f'{size} - 2', f'least({d.get(labels, "i")}, {d.get(labels, "i + 1")}) * 10 + greatest({d.get(labels, "i")}, {d.get(labels, "i + 1")})')} ELSE {d.empty('double')} END")
            out += [(f"{prop}_comp_{c}", d.ratio(d.size(d.filter(labels, f"x = {c}")), size)) for c in (1, 2, 3)]
            out += [(f"{prop}_trans_{a}{b}", d.ratio(d.size(d.filter(pairs, f"x = {10 * a + b}")), f"greatest({size} - 1, 0)")) for a, b in ((1, 2), (1, 3), (2, 3))]
            for c in (1, 2, 3):
                places = d.let(f"places_{tag}_{c}", d.filter(d.mapi(labels, f"CASE WHEN x = {c} THEN i + 1 END"), "x IS NOT NULL"))
                count = d.let(f"places_{tag}_{c}_size", d.size(places))
                for name, share in _POINTS.items():
                    at = f"cast(greatest(ceil({d.number(share)} * {count}) - 1, 0) as int)"
                    out.append((f"{prop}_dist_{c}_{name}", d.where(f"{count} > 0", f"{d.get(places, at)} / {d.number(1)} / n")))
        return out


TRACKED = {g: GROUPS[g] for g in ("charged", "hydrophobic", "aromatic", "polar", "positive", "negative")} | {"gly": "G", "pro": "P"}


@register("distribution", family="ctd", groups=maybe(named(TEXT)))
class Distribution(Descriptor):
    """How a group's residues spread over thirds and quarters of the sequence."""

    def __init__(self, *, groups: Mapping[str, str] | None = None) -> None:
        self.groups = groups or TRACKED

    def features(self, d: Dialect) -> list[tuple[str, str]]:
        out = lengths()
        for g, members in self.groups.items():
            places = d.places("".join(members))
            count = d.let(f"{places}_size", d.size(places))
            out.append((f"{g}_count", d.where("n > 0", count)))
            for bins, label in ((3, "tercile"), (4, "quartile")):
                p = f"{g}_{label}"
                share = []
                for i in range(bins):
                    hits = d.size(d.filter(places, f"least(floor(x * {bins} / {d.number(1)} / n), {bins - 1}) = {i}"))
                    share.append(d.let(f"share_{d.key(members, bins)}_{i}", f"CASE WHEN n = 0 THEN {d.nan} WHEN {count} = 0 THEN {d.number(0)} ELSE {hits} / {d.number(1)} / {count} END"))
                some = lambda sql: d.where(f"{count} > 0", sql)  # noqa: E731, B023
                out += [(f"{p}_bin{i + 1}_frac", s) for i, s in enumerate(share)]
                out += [(f"{p}_cum{i + 1}", " + ".join(share[: i + 1])) for i in range(bins)]
                out.append((f"{p}_entropy", some("0 - (" + " + ".join(f"CASE WHEN {s} > 0 THEN {s} * log2({s}) ELSE 0 END" for s in share) + ")")))
                out += [(f"{p}_max_bin_frac", some(f"greatest({', '.join(share)})"))]
                out.append((f"{p}_spread", some("(" + " + ".join(f"CASE WHEN {s} > 0 THEN 1 ELSE 0 END" for s in share) + f") / {d.number(bins)}")))
                out += [(f"{p}_bin{i + 1}_enrichment", some(f"{s} - {d.number(1 / bins)}")) for i, s in enumerate(share)]
        return out
