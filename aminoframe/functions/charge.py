"""Charges at a pH."""

from __future__ import annotations

from .alphabet import PKA_C_TERM, PKA_N_TERM, PKA_NEGATIVE, PKA_POSITIVE


def held(exponent: float) -> float:
    return 1.0 / (1.0 + 10.0**exponent)


def end_charge(ph: float) -> float:
    """Of both ends together."""
    return held(ph - PKA_N_TERM) - held(PKA_C_TERM - ph)


def residue_charge(ph: float) -> dict[str, float]:
    return {a: held(ph - pk) for a, pk in PKA_POSITIVE.items()} | {a: -held(pk - ph) for a, pk in PKA_NEGATIVE.items()}
