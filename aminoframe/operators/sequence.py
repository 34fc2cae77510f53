"""Order along the sequence: pseudo composition, coupling, autocorrelation, published scales and the family summary."""

from __future__ import annotations

import math
from collections.abc import Mapping

from ..functions.alphabet import CHARGE_PROXY, EISENBERG, FLEXIBILITY, GROUPS, HELIX, HYDROPATHY, HYDROPHILICITY, POLARITY, RESIDUES, SHEET, SIDECHAIN_MASS, TURN, VOLUME
from ..functions.dialect import Counts, Dialect, segment
from ..functions.vectors import SCALED
from ..sources.scales import known_scales
from .base import Descriptor, lengths, register
from .kinds import FLAG, NUMBER, TEXT, WHOLE, ParameterError, maybe, named, several
from .complexity import TRACKED, longest_homopolymer

PROPERTIES = {"hydrophobicity": EISENBERG, "hydrophilicity": HYDROPHILICITY, "sidechain_mass": SIDECHAIN_MASS}


def _whole(scales: Mapping[str, Mapping[str, float]]) -> dict[str, dict[str, float]]:
    for name, scale in scales.items():
        if missing := sorted(set(RESIDUES) - set(scale)):
            raise ParameterError("properties", f"properties: {name} has no value for {', '.join(missing)}")
    return {name: dict(scale) for name, scale in scales.items()}


def zscores(scale: Mapping[str, float]) -> dict[str, float]:
    values = [scale[a] for a in RESIDUES]
    mean = sum(values) / 20
    std = math.sqrt(sum((v - mean) ** 2 for v in values) / 20)
    return {a: (scale[a] - mean) / std if std else 0.0 for a in RESIDUES}


class _Pseudo(Descriptor):
    """Composition and lagged differences of properties, scaled to a common sum."""

    term = ""

    def __init__(self, *, lam: int = 5, w: float = 0.05, properties: Mapping[str, Mapping[str, float]] | None = None) -> None:
        self.lam, self.w, self.properties = lam, w, _whole(properties or PROPERTIES)

    def features(self, d: Dialect) -> list[tuple[str, str]]:
        c = Counts(d)
        key = d.key(*(sorted(s.items()) for s in self.properties.values()))
        z = [zscores(s) for s in self.properties.values()]
        arrays = [] if d.vectors else [d.values(f"z_{key}_{i}", s) for i, s in enumerate(z)]
        theta = []
        for lag in range(1, self.lam + 1):
            if d.vectors:
                total = d.coupled(RESIDUES, lag, "square", *(tuple(s[a] for a in RESIDUES) for s in z))
                theta.append(d.let(f"theta_{key}_{lag}", f"CASE WHEN n > {lag} THEN {total} / (n - {lag}) ELSE {d.number(0)} END"))
                continue
            square = " + ".join(f"({d.get(a, 'i')} - {d.get(a, f'i + {lag}')}) * ({d.get(a, 'i')} - {d.get(a, f'i + {lag}')})" for a in arrays)
            theta.append(d.let(f"theta_{key}_{lag}", f"CASE WHEN n > {lag} THEN {d.total(d.over('0', f'n - {lag + 1}', f'({square}) / {d.number(len(arrays))}'))} / (n - {lag}) ELSE {d.number(0)} END"))
        w = d.number(self.w)
        total = d.let(f"pseudo_{self.term}_{key}_{self.lam}", f"1 + {w} * ({' + '.join(theta) or '0'})")
        some = lambda sql: d.where("n > 0", sql)
        out = [*lengths(), *((a, some(f"{c.of[a]} / {d.number(1)} / n / {total}")) for a in RESIDUES)]
        out += [(f"{self.term}_{i}", some(f"{w} * {t} / {total}")) for i, t in enumerate(theta, 1)]
        return [*out, ("feature_sum", some(f"(1 + {w} * ({' + '.join(theta) or '0'})) / {total}"))]


@register("pseaac", family="pseudo", lam=WHOLE, w=NUMBER, properties=maybe(named(named(NUMBER))))
class PseudoComposition(_Pseudo):
    """Pseudo amino-acid composition."""

    term = "theta"


@register("qso", family="pseudo", lam=WHOLE, w=NUMBER, properties=maybe(named(named(NUMBER))))
class SequenceOrderCoupling(_Pseudo):
    """Composition with sequence-order couplings; as pseaac, with another weight and names."""

    term = "tau"

    def __init__(self, *, lam: int = 5, w: float = 0.1, properties: Mapping[str, Mapping[str, float]] | None = None) -> None:
        super().__init__(lam=lam, w=w, properties=properties)


CHANGES = {
    "charged_hydrophobic_transition_frac": ("charged", "hydrophobic"),
    "polar_nonpolar_transition_frac": ("polar", "nonpolar"),
    "disorder_order_transition_frac": ("disorder_promoting", "order_promoting"),
    "positive_negative_transition_frac": ("positive", "negative"),
}


@register("sequence_order", family="pseudo")
class SequenceOrder(Descriptor):
    """How residues of a group follow each other."""

    @staticmethod
    def _by_pairs(d: Dialect, members: str) -> tuple[dict[int, str], str, str]:
        """(coupling at lags 1 and 2, mean spacing, share of crowded triples) from pair counts, places and a profile."""
        name = "".join(sorted(set(members)))
        count = Counts(d).count(name)
        extent = dict(d.stats(d.array(f"places_{name}", "places", name), ("amplitude",)))["amplitude"]
        crowded = d.share(d.rolling(d.mask(name), 3), f"x > {d.number(0.5)}")
        lag = {k: d.let(f"both{k}_{name}", d.where(f"n > {k}", f"{d.coupled(RESIDUES, k, 'inside', name)} / (n - {k})")) for k in (1, 2)}
        return lag, d.where(f"{count} > 1", f"{extent} / ({count} - 1) / n"), crowded

    @staticmethod
    def _by_places(d: Dialect, members: str) -> tuple[dict[int, str], str, str]:
        """The same from arrays of places."""
        m, places = d.mask(members), d.places(members)
        size = d.let(f"{places}_size", d.size(places))
        lag = {k: d.let(f"both{k}_{m}", d.where(f"n > {k}", f"{d.total(d.over('0', f'greatest(n - {k + 1}, 0)', f'{d.get(m, "i")} * coalesce({d.get(m, f"i + {k}")}, 0)'))} / (n - {k})")) for k in (1, 2)}
        spacing = d.where(f"{size} > 1", f"({d.get(places, f'greatest({size} - 1, 0)')} - {d.get(places, 0)}) / {d.number(1)} / ({size} - 1) / n")
        three = " + ".join(d.get(m, f"i + {j}") for j in range(3))
        cluster = d.where("n > 2", f"{d.total(d.over('0', 'greatest(n - 3, 0)', f'CASE WHEN {three} >= 2 THEN {d.number(1)} ELSE {d.number(0)} END'))} / (n - 2)")
        return lag, spacing, cluster

    def features(self, d: Dialect) -> list[tuple[str, str]]:
        c, out = Counts(d), lengths()
        for g in TRACKED:
            lag, spacing, cluster = (self._by_pairs if d.vectors else self._by_places)(d, GROUPS[g])
            share = c.fraction(GROUPS[g])
            enrichment = d.where(f"n > 1 AND {c.count(GROUPS[g])} > 0", f"{lag[1]} / ({share} * {share})")
            out += [(f"{g}_{k}", v) for k, v in (("same_adj_frac", lag[1]), ("mean_spacing_norm", spacing), ("cluster_frac_w3", cluster), ("lag1_coupling", lag[1]), ("lag2_coupling", lag[2]), ("adj_enrichment", enrichment))]
        for name, (a, b) in CHANGES.items():
            if d.vectors:
                out.append((name, d.where("n > 1", f"{d.coupled(RESIDUES, 1, 'across', GROUPS[a], GROUPS[b])} / (n - 1)")))
                continue
            x, y = d.mask(GROUPS[a]), d.mask(GROUPS[b])
            hit = f"CASE WHEN {d.get(x, 'i')} * {d.get(y, 'i + 1')} + {d.get(y, 'i')} * {d.get(x, 'i + 1')} > 0 THEN {d.number(1)} ELSE {d.number(0)} END"
            out.append((name, d.where("n > 1", f"{d.total(d.over('0', 'greatest(n - 2, 0)', hit))} / (n - 1)")))
        return out


SCALES = {"hydrophobicity": HYDROPATHY, "polarity": POLARITY, "flexibility": FLEXIBILITY, "volume": VOLUME, "charge_proxy": CHARGE_PROXY}


@register("autocorrelation", family="autocorrelation", scales=maybe(named(named(NUMBER))), lags=several(WHOLE))
class Autocorrelation(Descriptor):
    """Moreau-Broto, Moran and Geary autocorrelation of scales at several lags.

    Residues without a value in a scale are left out before lags are taken.  Where all values are equal, Moran and Geary
    are undefined.
    """

    def __init__(self, *, scales: Mapping[str, Mapping[str, float]] | None = None, lags: tuple[int, ...] = (1, 2, 3, 4, 5)) -> None:
        self.scales, self.lags = {k: dict(v) for k, v in (scales or SCALES).items()}, tuple(lags)

    def _by_pairs(self, d: Dialect, name: str, scale: dict[str, float]) -> list[tuple[str, str]]:
        """From residue counts, and from the pair counts at each lag."""
        c, out = Counts(d), []
        scale = {a: v for a, v in scale.items() if a in RESIDUES}
        known = "".join(a for a in RESIDUES if a in scale)
        values = tuple(float(scale.get(a, 0.0)) for a in RESIDUES)
        tag = d.key(sorted(scale.items()))
        size = d.let(f"auto_{tag}_size", c.count(known) if known else "0")
        mean = d.let(f"auto_{tag}_mean", d.ratio(" + ".join(f"{c.of[a]} * {d.number(scale[a])}" for a in known) or d.number(0), size))
        square = " + ".join(f"{c.of[a]} * ({d.number(scale[a])} - {mean}) * ({d.number(scale[a])} - {mean})" for a in known) or d.number(0)
        variance = d.let(f"auto_{tag}_variance", d.ratio(square, size))
        varied = d.let(f"auto_{tag}_varied", c.varied(scale) if known else "false")
        for lag in self.lags:
            if lag < 1:
                out += [(f"{kind}_{name}_lag{lag}", d.nan) for kind in ("mb", "moran", "geary")]
                continue
            product, total, apart = d.coupled(known, lag, "product", values), d.coupled(known, lag, "sum", values), d.coupled(known, lag, "square", values)
            some, both = f"{size} > {lag}", f"{size} > {lag} AND {varied}"
            out.append((f"mb_{name}_lag{lag}", d.where(some, f"{product} / ({size} - {lag})")))
            out.append((f"moran_{name}_lag{lag}", d.where(both, f"(({product} - {mean} * {total}) / ({size} - {lag}) + {mean} * {mean}) / {variance}")))
            out.append((f"geary_{name}_lag{lag}", d.where(both, f"{apart} / ({size} - {lag}) / 2 / ({variance} * {size} / ({size} - 1))")))
        return out

    def features(self, d: Dialect) -> list[tuple[str, str]]:
        out = lengths()
        for name, scale in self.scales.items():
            tag = d.key(sorted(scale.items()))
            if d.vectors:
                out += self._by_pairs(d, name, scale)
                continue
            v = d.values(f"auto_{tag}", scale)
            if any(a not in scale for a in RESIDUES):
                gaps = d.values(f"auto_{tag}_known", {a: 1.0 for a in scale})
                kept = d.mapi(v, f"CASE WHEN {d.get(gaps, 'i')} > 0 THEN x END")
                v = d.profile(f"auto_{tag}_some", d.filter(kept, "x IS NOT NULL"), "known", v, "".join(sorted(scale)))
            s = dict(d.stats(v, ("mean", "std", "amplitude")))
            size, mean = f"{v}_size", f"{v}_mean"
            varied = f"{v}_high > {v}_low"
            variance = f"({s['std']} * {s['std']})"
            for lag in self.lags:
                if lag < 1:
                    out += [(f"{kind}_{name}_lag{lag}", d.nan) for kind in ("mb", "moran", "geary")]
                    continue
                here, there = d.get(v, "i"), d.get(v, f"i + {lag}")
                span = lambda body, lag=lag, size=size: f"{d.total(d.over('0', f'{size} - {lag + 1}', body))} / ({size} - {lag})"
                out.append((f"mb_{name}_lag{lag}", d.where(f"{size} > {lag}", span(f"{here} * {there}"))))
                out.append((f"moran_{name}_lag{lag}", d.where(f"{size} > {lag} AND {varied}", f"{span(f'({here} - {mean}) * ({there} - {mean})')} / {variance}")))
                out.append((f"geary_{name}_lag{lag}", d.where(f"{size} > {lag} AND {varied}", f"{span(f'({here} - {there}) * ({here} - {there})')} / 2 / ({variance} * {size} / ({size} - 1))")))
        return out


@register("aaindex", family="aaindex", codes=several(TEXT), include_terminal=FLAG, terminal_window=WHOLE)
class AAIndex(Descriptor):
    """Statistics of published residue scales, in all and at both ends."""

    def __init__(self, *, codes: tuple[str, ...] = ("ANDN920101", "ARGP820101", "KYTJ820101", "FAUJ880104"), include_terminal: bool = True, terminal_window: int = 10) -> None:
        self.codes, self.include_terminal, self.terminal_window = tuple(codes), include_terminal, terminal_window
        for code in self.codes:
            if code not in known_scales():
                raise ParameterError("codes", f"codes: unknown AAindex code {code!r}; list_indices() names those that are known")

    def features(self, d: Dialect) -> list[tuple[str, str]]:
        return lengths() + (self._by_matrix if d.vectors else self._by_arrays)(d)

    def _by_matrix(self, d: Dialect) -> list[tuple[str, str]]:
        """All codes at once: the residue counts, times a matrix with a row for each scale."""
        scales = tuple(tuple(known_scales()[code].get(a) for a in RESIDUES) for code in self.codes)
        key, out, w = d.key(scales), [], self.terminal_window
        whole = d.figure(f"scales_{key}", "scaled", scales, None)
        ends = {side: d.figure(f"scales_{key}_{side}{w}", "scaled", scales, (side, w)) for side in "nc"} if self.include_terminal else {}
        for i, code in enumerate(self.codes):
            out += [(f"{code}_{k}", d.get(whole, len(SCALED) * i + j)) for j, k in enumerate(SCALED)]
            out += [(f"{code}_{side}term_mean_w{w}", d.get(means, i)) for side, means in ends.items()]
        return out

    def _by_arrays(self, d: Dialect) -> list[tuple[str, str]]:
        out, w = [], self.terminal_window
        for code in self.codes:
            scale = known_scales()[code]
            tag = d.key(sorted(scale.items()))
            v = d.values(f"aaindex_{tag}", scale)
            known = "".join(a for a in RESIDUES if a in scale)
            if len(known) < 20:
                gaps = d.values(f"aaindex_{tag}_known", {a: 1.0 for a in known})
                v = d.profile(f"aaindex_{tag}_some", d.filter(d.mapi(v, f"CASE WHEN {d.get(gaps, 'i')} > 0 THEN x END"), "x IS NOT NULL"), "known", v, known)
            s = dict(d.stats(v, ("mean", "std", "min", "max")))
            out += [(f"{code}_{k}", s[k]) for k in ("mean", "std", "min", "max")] + [(f"{code}_median", d.median(v))]
            if self.include_terminal:
                for side in "nc":
                    c = segment(d, side, w)
                    total = " + ".join(f"{c.of[a]} * {d.number(scale[a])}" for a in known)
                    out.append((f"{code}_{side}term_mean_w{w}", d.ratio(total, c.count(known))))
        return out


@register("family_summary", family="hybrid")
class FamilySummary(Descriptor):
    """A few figures of each family, and statistics over the families."""

    def features(self, d: Dialect) -> list[tuple[str, str]]:
        c = Counts(d)
        f = {g: c.fraction(m) for g, m in GROUPS.items()}
        mean = lambda *x: "(" + " + ".join(x) + f") / {d.number(len(x))}"
        pos, neg = d.mask(GROUPS["positive"]), d.mask(GROUPS["negative"])
        here, there = d.rolling(pos, 5), d.rolling(neg, 5)
        local = d.profile("local_balance5", d.mapi(here, f"x - {d.get(there, 'i')}"), "difference", here, there)
        s = dict(d.stats(local, ("mean", "amplitude")))
        hydropathy, polarity = c.mean("hydropathy", HYDROPATHY), c.mean("polarity", POLARITY)
        helix, sheet, turn = c.mean("helix", HELIX), c.mean("sheet", SHEET), c.mean("turn", TURN)
        burden = d.ratio(longest_homopolymer(d), "n")
        core = {
            "charge_family_mean": mean(f["positive"], f["negative"], f["charged"]),
            "physchem_family_mean": mean(hydropathy, polarity),
            "struct_family_mean": mean(helix, sheet, turn),
            "orderdis_family_mean": mean(f["disorder_promoting"], f["order_promoting"]),
            "functional_family_mean": mean(f["sulfur"], f["hydroxyl"], f["amide"], f["aromatic"]),
            "complexity_family_mean": mean(c.entropy(), burden),
        }
        core = {k: d.let(k, v) for k, v in core.items()}
        total = d.let("global_family_mean", mean(*core.values()))
        high, low = f"greatest({', '.join(core)})", f"least({', '.join(core)})"
        std = "sqrt((" + " + ".join(f"({x} - {total}) * ({x} - {total})" for x in core) + f") / {d.number(len(core))})"
        return [
            *lengths(),
            ("charge_family_mean", core["charge_family_mean"]), ("charge_family_balance", f"{f['positive']} - {f['negative']}"), ("charge_family_local_mean", s["mean"]), ("charge_family_local_amplitude", s["amplitude"]),
            ("physchem_family_mean", core["physchem_family_mean"]), ("physchem_family_dispersion", mean(c.std("hydropathy", HYDROPATHY), c.std("polarity", POLARITY))),
            ("physchem_hydrophobic_balance", f"{f['hydrophobic']} - {f['hydrophilic']}"), ("physchem_polar_balance", f"{f['polar']} - {f['nonpolar']}"),
            ("struct_family_mean", core["struct_family_mean"]), ("struct_helix_sheet_balance", f"{helix} - {sheet}"), ("struct_turn_secondary_balance", f"{turn} - ({helix} + {sheet}) / 2"),
            ("orderdis_family_mean", core["orderdis_family_mean"]), ("orderdis_balance", f"{f['disorder_promoting']} - {f['order_promoting']}"),
            ("functional_family_mean", core["functional_family_mean"]), ("functional_reactivity_proxy", mean(f["sulfur"], f["hydroxyl"], f["positive"], f["negative"])),
            ("complexity_family_mean", core["complexity_family_mean"]), ("complexity_entropy", c.entropy()), ("complexity_repeat_burden", burden),
            ("global_family_mean", total), ("global_family_std", std), ("global_family_max", high), ("global_family_min", low), ("global_family_amplitude", f"{high} - {low}"),
        ]
