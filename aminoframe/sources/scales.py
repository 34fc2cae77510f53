"""Published residue scales by AAindex code."""

from __future__ import annotations

import csv
from functools import lru_cache
from pathlib import Path

from ..functions.alphabet import HELIX, HYDROPATHY, POLARITY, SHEET, TURN, VOLUME

_ADDED: dict[str, dict[str, float]] = {}

# Published scales, in the order A R N D C Q E G H I L K M F P S T W Y V.
_ORDER = "ARNDCQEGHILKMFPSTWYV"
_ANDN920101 = (4.35, 4.38, 4.75, 4.76, 4.65, 4.37, 4.29, 3.97, 4.63, 3.95, 4.17, 4.36, 4.52, 4.66, 4.44, 4.50, 4.35, 4.70, 4.60, 3.95)
_ARGP820101 = (0.61, 0.60, 0.06, 0.46, 1.07, 0.0, 0.47, 0.07, 0.61, 2.22, 1.53, 1.15, 1.18, 2.02, 1.95, 0.05, 0.05, 2.65, 1.88, 1.32)
_FAUJ880104 = (2.87, 7.82, 4.58, 4.74, 4.47, 6.11, 5.97, 2.06, 5.23, 4.92, 4.92, 6.89, 6.36, 4.62, 4.11, 3.97, 4.11, 7.68, 4.73, 4.11)


@lru_cache(maxsize=1)
def _bundled() -> dict[str, dict[str, float]]:
    listed = {"ANDN920101": _ANDN920101, "ARGP820101": _ARGP820101, "FAUJ880104": _FAUJ880104}
    named = {"KYTJ820101": HYDROPATHY, "PONJ960101": VOLUME, "ZIMJ680103": POLARITY, "CHOP780201": HELIX, "CHOP780202": SHEET, "CHOP780203": TURN}
    return {code: dict(zip(_ORDER, values, strict=True)) for code, values in listed.items()} | named


def known_scales() -> dict[str, dict[str, float]]:
    return _bundled() | _ADDED


def load_scales(path: str) -> list[str]:
    """Adds the scales of a CSV file with a column ``index`` and one for each residue; blank cells have no value."""
    with Path(path).open(encoding="utf-8", newline="") as f:
        for row in csv.DictReader(f):
            _ADDED[row["index"]] = {a: float(v) for a, v in row.items() if a != "index" and v not in (None, "")}
    return list_indices()


def list_indices() -> list[str]:
    """The known codes, sorted."""
    return sorted(known_scales())
