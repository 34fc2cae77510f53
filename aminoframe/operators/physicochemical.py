"""Physicochemical properties: charge, hydrophobicity, disorder, secondary structure."""

from __future__ import annotations

from ..functions.alphabet import ACCEPTORS, BOMAN, DONORS, FLEXIBILITY, GROUPS, HELIX, HYDROPATHY, MOLECULAR_WEIGHT, PKA_NEGATIVE, PKA_POSITIVE, POLARITY, RESIDUES, SHEET, TURN, WATER
from ..functions.charge import end_charge, held, residue_charge
from ..functions.dialect import Counts, Dialect, segment
from .base import Descriptor, lengths, register
from .kinds import NUMBER, WHOLE, several
from .complexity import Words, linguistic, longest_homopolymer, longest_run
from .composition import _unique

STATS = ("mean", "std", "min", "max", "amplitude", "start_end_diff")


def _weighted(d: Dialect, c: Counts, weights: dict[str, float]) -> str:
    return "(" + " + ".join(f"{c.of[a]} * {d.number(v)}" for a, v in weights.items()) + ")"


@register("charge", family="physicochemical", ph_values=several(NUMBER), local_window=WHOLE, terminal_window=WHOLE)
class Charge(Descriptor):
    """Charged fractions, and net charges in all, locally and at both ends at several pH."""

    def __init__(self, *, ph_values: tuple[float, ...] = (5.0, 7.0, 9.0), local_window: int = 5, terminal_window: int = 10) -> None:
        self.ph_values, self.local_window, self.terminal_window = tuple(ph_values), local_window, terminal_window

    def features(self, d: Dialect) -> list[tuple[str, str]]:
        c, w = Counts(d), self.local_window
        pos, neg = c.fraction("KRH"), c.fraction("DE")
        out = [*lengths(), ("positive_fraction", pos), ("negative_fraction", neg), ("ionizable_fraction", c.fraction("CDEHKRY")), ("fcr", f"{pos} + {neg}"), ("ncpr", f"{pos} - {neg}")]
        out += [("basic_acidic_ratio", d.ratio(c.count("KRH"), c.count("DE"))), ("acidic_basic_ratio", d.ratio(c.count("DE"), c.count("KRH")))]
        ends = {side: segment(d, side, self.terminal_window) for side in "nc"}
        for ph in self.ph_values:
            tag = "ph" + str(ph).replace(".", "p")
            net = d.let(f"net_{tag}", c.net_charge(ph))
            out += [(f"net_charge_{tag}", net), (f"density_{tag}", d.where("n > 0", f"{net} / n"))]
            basic = {a: held(ph - PKA_POSITIVE[a]) for a in "KRH"}
            acidic = {a: held(PKA_NEGATIVE[a] - ph) for a in "DE"}
            out += [(f"protonated_basic_fraction_{tag}", d.ratio(_weighted(d, c, basic), c.count("KRH"))), (f"deprotonated_acidic_fraction_{tag}", d.ratio(_weighted(d, c, acidic), c.count("DE")))]
            profile = d.rolling(d.values(f"charge_{tag}", residue_charge(ph)), w)
            local = d.profile(f"local_{tag}", d.map(profile, f"x + {d.number(end_charge(ph) / w)}"), "shift", profile, end_charge(ph) / w)
            out += [(f"local_{k}_{tag}", v) for k, v in d.stats(local, STATS)]
            nets = {side: d.let(f"{side}net_{tag}", s.net_charge(ph)) for side, s in ends.items()}
            density = {side: d.where(f"{s.n} > 0", f"{nets[side]} / {s.n}") for side, s in ends.items()}
            out += [(f"{side}term_net_{tag}", nets[side]) for side in "nc"] + [(f"{side}term_density_{tag}", density[side]) for side in "nc"]
            out.append((f"terminal_asymmetry_{tag}", f"{density['n']} - {density['c']}"))
        return out


@register("global_basic", family="physicochemical")
class GlobalBasic(Descriptor):
    """Weight, group fractions, scale means and simple complexity of the whole sequence."""

    def features(self, d: Dialect) -> list[tuple[str, str]]:
        c = Counts(d)
        out = [*lengths(), ("unique_residue_count", _unique(c)), ("molecular_weight", d.where("n > 0", f"{_weighted(d, c, MOLECULAR_WEIGHT)} - (n - 1) * {d.number(WATER)}"))]
        out += [(f"{g}_fraction", c.fraction(m)) for g, m in GROUPS.items()]
        out.append(("aliphatic_index", d.where("n > 0", f"100 * ({c.of['A']} + {d.number(2.9)} * {c.of['V']} + {d.number(3.9)} * ({c.of['I']} + {c.of['L']})) / n")))
        for name, scale in (("hydropathy", HYDROPATHY), ("polarity", POLARITY), ("flexibility", FLEXIBILITY)):
            out += [(f"{name}_mean", c.mean(name, scale)), (f"{name}_std", c.std(name, scale))]
        out += [(f"{name}_propensity_mean", c.mean(name, scale)) for name, scale in (("helix", HELIX), ("sheet", SHEET), ("turn", TURN))]
        pos, neg = c.count(GROUPS["positive"]), c.count(GROUPS["negative"])
        out += [("boman_index", f"0 - {c.mean('boman', BOMAN)}"), ("net_charge_ph7", c.net_charge(7.0)), ("fcr", d.ratio(f"{pos} + {neg}", "n")), ("ncpr", d.ratio(f"{pos} - {neg}", "n"))]
        out += [("acidic_basic_ratio", d.ratio(neg, pos)), ("basic_acidic_ratio", d.ratio(pos, neg)), ("donors_per_residue", c.fraction(DONORS)), ("acceptors_per_residue", c.fraction(ACCEPTORS))]
        out += [("shannon_entropy", c.entropy()), *((f"linguistic_complexity_k{k}", linguistic(d, k)) for k in (1, 2, 3)), ("longest_homopolymer_run", longest_homopolymer(d))]
        out.append(("repeated_dipeptide_fraction", Words(d, 2).repeated_fraction()))
        profile = d.rolling(d.values("hydropathy", HYDROPATHY), 5)
        return [*out, ("local_hydropathy_amplitude_w5", dict(d.stats(profile, ("amplitude",)))["amplitude"])]


def _ends(d: Dialect, w: int, name: str, scale: dict[str, float]) -> tuple[str, str]:
    return segment(d, "n", w).mean(name, scale), segment(d, "c", w).mean(name, scale)


@register("hydrophobicity", family="physicochemical", window_sizes=several(WHOLE), terminal_window=WHOLE)
class Hydrophobicity(Descriptor):
    """Hydropathy and polarity, in all, at the ends and in windows; patches of either."""

    def __init__(self, *, window_sizes: tuple[int, ...] = (5, 7, 9), terminal_window: int = 10) -> None:
        self.window_sizes, self.terminal_window = tuple(window_sizes), terminal_window

    def features(self, d: Dialect) -> list[tuple[str, str]]:
        c = Counts(d)
        f = {g: c.fraction(GROUPS[g]) for g in ("hydrophobic", "hydrophilic", "polar", "nonpolar", "aromatic")}
        hydropathy, polarity = c.mean("hydropathy", HYDROPATHY), c.mean("polarity", POLARITY)
        out = [*lengths(), ("hydropathy_mean", hydropathy), ("hydropathy_std", c.std("hydropathy", HYDROPATHY)), ("polarity_mean", polarity), ("polarity_std", c.std("polarity", POLARITY))]
        out += [(f"{g}_fraction", x) for g, x in f.items()]
        out += [("hydrophobic_hydrophilic_balance", f"{f['hydrophobic']} - {f['hydrophilic']}"), ("polar_nonpolar_balance", f"{f['polar']} - {f['nonpolar']}")]
        out.append(("global_amphipathicity_proxy", f"abs({f['hydrophobic']} - {f['polar']}) * abs({hydropathy} - {polarity})"))
        h, p = _ends(d, self.terminal_window, "hydropathy", HYDROPATHY), _ends(d, self.terminal_window, "polarity", POLARITY)
        out += [("nterm_hydropathy_mean", h[0]), ("cterm_hydropathy_mean", h[1]), ("nterm_polarity_mean", p[0]), ("cterm_polarity_mean", p[1])]
        out += [("terminal_hydropathy_asymmetry", f"{h[0]} - {h[1]}"), ("terminal_polarity_asymmetry", f"{p[0]} - {p[1]}")]
        arrays = [d.values("hydropathy", HYDROPATHY), d.values("polarity", POLARITY), d.mask(GROUPS["hydrophobic"]), d.mask(GROUPS["polar"])]
        for w in self.window_sizes:
            hyd, pol, hf, pf = (d.rolling(a, w) for a in arrays)
            contrast = d.profile(f"contrast{w}", d.mapi(hf, f"abs(x - {d.get(pf, 'i')})"), "absdiff", hf, pf)
            apart = d.profile(f"apart{w}", d.mapi(hyd, f"abs(x - {d.get(pol, 'i')})"), "absdiff", hyd, pol)
            amphi = d.profile(f"amphi{w}", d.mapi(contrast, f"x * {d.get(apart, 'i')}"), "product", contrast, apart)
            for name, array in (("hydropathy", hyd), ("polarity", pol), ("hydrophobic_frac", hf), ("polar_frac", pf), ("contrast", contrast), ("amphipathicity", amphi)):
                out += [(f"w{w}_{name}_{k}", v) for k, v in d.stats(array, STATS)]
            for name, array, least in (("hydrophobic_patch", hf, 0.6), ("polar_patch", pf, 0.6), ("high_amphipathicity", amphi, 1.0)):
                out.append((f"w{w}_{name}_fraction", d.share(array, f"x > {d.number(least)}")))
        return out


@register("order_disorder", family="physicochemical", window_sizes=several(WHOLE), terminal_window=WHOLE)
class OrderDisorder(Descriptor):
    """Residues that promote order or disorder: fractions, runs, changes and patches."""

    def __init__(self, *, window_sizes: tuple[int, ...] = (5, 7), terminal_window: int = 10) -> None:
        self.window_sizes, self.terminal_window = tuple(window_sizes), terminal_window

    def features(self, d: Dialect) -> list[tuple[str, str]]:
        c, dis, order = Counts(d), GROUPS["disorder_promoting"], GROUPS["order_promoting"]
        a, b = c.fraction(dis), c.fraction(order)
        some = lambda sql: d.where("n > 0", sql)
        out = [*lengths(), ("disorder_fraction", a), ("order_fraction", b), ("disorder_order_balance", f"{a} - {b}"), ("order_disorder_balance", f"{b} - {a}")]
        out += [("disorder_order_ratio", d.ratio(c.count(dis), c.count(order))), ("order_disorder_ratio", d.ratio(c.count(order), c.count(dis)))]
        for name, members in (("flexibility", "GSP"), ("rigidity", "ILVFYW"), ("pro_gly", "PG"), ("aromatic_aliphatic_order", "FWYILV"), ("polar_disorder_support", "STNQDEKR")):
            out.append((f"{name}_fraction", c.fraction(members)))
        out += [("longest_disorder_run", some(longest_run(d, dis))), ("longest_order_run", some(longest_run(d, order)))]
        x, y = d.mask(order), d.mask(dis)
        if d.vectors:
            changes = d.coupled(RESIDUES, 1, "across", order, dis)
        else:
            change = f"{d.get(x, 'i')} * {d.get(y, 'i + 1')} + {d.get(y, 'i')} * {d.get(x, 'i + 1')}"
            changes = d.total(d.over("0", "greatest(n - 2, 0)", change))
        out.append(("order_disorder_transition_fraction", d.where("n > 1", f"{changes} / (n - 1)")))
        ends = {side: segment(d, side, self.terminal_window) for side in "nc"}
        share = {(side, g): s.fraction(GROUPS[f"{g}_promoting"]) for g in ("disorder", "order") for side, s in ends.items()}
        out += [(f"{side}term_{g}_fraction", x) for (side, g), x in share.items()]
        out += [(f"terminal_{g}_asymmetry", f"{share['n', g]} - {share['c', g]}") for g in ("disorder", "order")]
        for w in self.window_sizes:
            profiles = {"disorder": d.rolling(y, w), "order": d.rolling(x, w)}
            more_than_half = d.number((w // 2 + 0.5) / w)
            out += [(f"w{w}_{g}_patch_fraction", d.share(p, f"x > {more_than_half}")) for g, p in profiles.items()]
            out += [(f"w{w}_{g}_mean", dict(d.stats(p, ("mean",)))["mean"]) for g, p in profiles.items()]
        return out


@register("structural_propensity", family="physicochemical", window_sizes=several(WHOLE), threshold=NUMBER)
class StructuralPropensity(Descriptor):
    """Helix, sheet and turn propensities, in all and in windows."""

    def __init__(self, *, window_sizes: tuple[int, ...] = (5, 7), threshold: float = 1.0) -> None:
        self.window_sizes, self.threshold = tuple(window_sizes), threshold

    def features(self, d: Dialect) -> list[tuple[str, str]]:
        c, scales = Counts(d), {"helix": HELIX, "sheet": SHEET, "turn": TURN}
        mean = {k: c.mean(k, s) for k, s in scales.items()}
        out = [*lengths(), *((f"{k}_mean", v) for k, v in mean.items()), *((f"{k}_std", c.std(k, s)) for k, s in scales.items())]
        out += [(f"{k}_favoring_fraction", c.fraction("".join(a for a in RESIDUES if s[a] >= 1.0))) for k, s in scales.items()]
        out += [("helix_sheet_balance", f"{mean['helix']} - {mean['sheet']}"), ("turn_vs_secondary_balance", f"{mean['turn']} - ({mean['helix']} + {mean['sheet']}) / 2")]
        for w in self.window_sizes:
            profiles = {k: d.rolling(d.values(k, s), w) for k, s in scales.items()}
            for k, array in profiles.items():
                out += [(f"w{w}_{k}_{stat}", v) for stat, v in d.stats(array, STATS[:5])]
                out.append((f"w{w}_{k}_high_fraction", d.share(array, f"x > {d.number(self.threshold)}")))
            balance = d.profile(f"balance{w}", d.mapi(profiles["helix"], f"x - {d.get(profiles['sheet'], 'i')}"), "difference", profiles["helix"], profiles["sheet"])
            s = dict(d.stats(balance, ("mean", "max", "min")))
            out += [(f"w{w}_helix_sheet_balance_{k}", s[k]) for k in ("mean", "max", "min")]
        return out
