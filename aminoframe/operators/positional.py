"""Positional features: normalised places, sliding windows and both ends."""

from __future__ import annotations

from collections.abc import Mapping

from ..functions.alphabet import GROUPS, HYDROPATHY, POLARITY, RESIDUES
from ..functions.dialect import Dialect, segment
from .base import Descriptor, lengths, register
from .kinds import TEXT, WHOLE, maybe, named, several
from .complexity import window_entropies
from .ctd import TRACKED
from .physicochemical import STATS

PLACED = TRACKED | {"trp": "W", "tyr": "Y"}


@register("normalized", family="positional", groups=maybe(named(TEXT)))
class NormalizedPosition(Descriptor):
    """Where a group's residues stand, as shares of the length."""

    def __init__(self, *, groups: Mapping[str, str] | None = None) -> None:
        self.groups = groups or PLACED

    def features(self, d: Dialect) -> list[tuple[str, str]]:
        out = lengths()
        for g, members in self.groups.items():
            places = d.places("".join(members))
            norm = d.let(f"{places}_norm", d.map(places, f"x / {d.number(1)} / n"))
            s, size = dict(d.stats(norm, ("mean", "std", "min", "max", "amplitude"))), d.let(f"{norm}_size", d.size(norm))
            out += [(f"{g}_count", size), (f"{g}_first_norm", s["min"]), (f"{g}_last_norm", s["max"]), (f"{g}_mean_norm", s["mean"]), (f"{g}_median_norm", d.median(norm)), (f"{g}_std_norm", s["std"]), (f"{g}_span_norm", s["amplitude"])]
            out += [(f"{g}_n_bias", d.share(norm, f"x <= {d.number(0.33)}")), (f"{g}_c_bias", d.share(norm, f"x >= {d.number(0.67)}")), (f"{g}_center_mass_norm", s["mean"])]
        return out


@register("sliding_window", family="positional", window_sizes=several(WHOLE))
class SlidingWindow(Descriptor):
    """Hydropathy, polarity, charge, aromatic and entropy profiles of windows."""

    def __init__(self, *, window_sizes: tuple[int, ...] = (5, 7, 9)) -> None:
        self.window_sizes = tuple(window_sizes)

    def features(self, d: Dialect) -> list[tuple[str, str]]:
        out = lengths()
        arrays = {"hydropathy": d.values("hydropathy", HYDROPATHY), "polarity": d.values("polarity", POLARITY), "charged_frac": d.mask(GROUPS["charged"]), "aromatic_frac": d.mask(GROUPS["aromatic"])}
        for w in self.window_sizes:
            profiles = {k: d.rolling(a, w) for k, a in arrays.items()} | {"entropy": window_entropies(d, w)}
            for name, array in profiles.items():
                out += [(f"win{w}_{name}_{k}", v) for k, v in d.stats(array, STATS)]
            for name, key, test in (("hydropathy_high", "hydropathy", "x > 1.0"), ("charged_high", "charged_frac", "x > 0.4"), ("aromatic_high", "aromatic_frac", "x > 0.2"), ("low_entropy", "entropy", "x < 1.5")):
                value = test.split()[2]
                out.append((f"win{w}_{name}_fraction", d.share(profiles[key], test.replace(value, d.number(float(value))))))
        return out


@register("terminal", family="positional", window_sizes=several(WHOLE))
class Terminal(Descriptor):
    """Composition and properties of the first and last residues."""

    def __init__(self, *, window_sizes: tuple[int, ...] = (5, 10, 20)) -> None:
        self.window_sizes = tuple(window_sizes)

    def features(self, d: Dialect) -> list[tuple[str, str]]:
        out = lengths()
        for w in self.window_sizes:
            for side in "nc":
                c, p = segment(d, side, w), f"{side}term{w}"
                f = {g: c.fraction(m) for g, m in GROUPS.items()}
                out += [(f"{p}_length", c.n), (f"{p}_hydropathy_mean", c.mean("hydropathy", HYDROPATHY)), (f"{p}_polarity_mean", c.mean("polarity", POLARITY)), (f"{p}_entropy", c.entropy())]
                out += [(f"{p}_{g}_frac", x) for g, x in f.items()]
                out += [(f"{p}_positive_negative_balance", f"{f['positive']} - {f['negative']}"), (f"{p}_hydrophobic_hydrophilic_balance", f"{f['hydrophobic']} - {f['hydrophilic']}")]
                out.append((f"{p}_positive_negative_ratio", d.ratio(c.count(GROUPS["positive"]), c.count(GROUPS["negative"]))))
                out += [(f"{p}_aac_{a}", c.fraction(a)) for a in RESIDUES]
        return out
