"""Residues, groups, scales and pK values."""

from __future__ import annotations

# Published amino-acid scales and the groups and constants that results depend on.

RESIDUES = "ACDEFGHIKLMNPQRSTVWY"

HYDROPATHY = {"A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8, "G": -0.4, "H": -3.2, "I": 4.5, "K": -3.9, "L": 3.8, "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5, "R": -4.5, "S": -0.8, "T": -0.7, "V": 4.2, "W": -0.9, "Y": -1.3}
EISENBERG = {"A": 0.62, "C": 0.29, "D": -0.9, "E": -0.74, "F": 1.19, "G": 0.48, "H": -0.4, "I": 1.38, "K": -1.5, "L": 1.06, "M": 0.64, "N": -0.78, "P": 0.12, "Q": -0.85, "R": -2.53, "S": -0.18, "T": -0.05, "V": 1.08, "W": 0.81, "Y": 0.26}
HYDROPHILICITY = {"A": -0.5, "C": -1.0, "D": 3.0, "E": 3.0, "F": -2.5, "G": 0.0, "H": -0.5, "I": -1.8, "K": 3.0, "L": -1.8, "M": -1.3, "N": 0.2, "P": 0.0, "Q": 0.2, "R": 3.0, "S": 0.3, "T": -0.4, "V": -1.5, "W": -3.4, "Y": -2.3}
SIDECHAIN_MASS = {"A": 15.0, "C": 47.0, "D": 59.0, "E": 73.0, "F": 91.0, "G": 1.0, "H": 82.0, "I": 57.0, "K": 72.0, "L": 57.0, "M": 75.0, "N": 58.0, "P": 41.0, "Q": 72.0, "R": 100.0, "S": 31.0, "T": 45.0, "V": 43.0, "W": 130.0, "Y": 107.0}
VOLUME = {"A": 91.5, "C": 114.4, "D": 135.2, "E": 154.6, "F": 198.8, "G": 67.5, "H": 163.2, "I": 162.6, "K": 162.5, "L": 163.4, "M": 165.9, "N": 138.3, "P": 123.4, "Q": 156.4, "R": 196.1, "S": 102.0, "T": 126.0, "V": 138.4, "W": 209.8, "Y": 237.2}
MOLECULAR_WEIGHT = {"A": 89.09, "C": 121.15, "D": 133.1, "E": 147.13, "F": 165.19, "G": 75.07, "H": 155.16, "I": 131.17, "K": 146.19, "L": 131.17, "M": 149.21, "N": 132.12, "P": 115.13, "Q": 146.15, "R": 174.2, "S": 105.09, "T": 119.12, "V": 117.15, "W": 204.23, "Y": 181.19}
BOMAN = {"A": 1.81, "C": 1.28, "D": -8.72, "E": -6.81, "F": 2.98, "G": 0.94, "H": -4.66, "I": 4.92, "K": -5.55, "L": 4.92, "M": 2.35, "N": -6.64, "P": 0.0, "Q": -5.54, "R": -14.92, "S": -3.4, "T": -2.57, "V": 4.04, "W": 2.33, "Y": -0.14}
POLARITY = {"A": 0.0, "C": 1.48, "D": 49.7, "E": 49.9, "F": 0.35, "G": 0.0, "H": 51.6, "I": 0.13, "K": 49.5, "L": 0.13, "M": 1.43, "N": 3.38, "P": 1.58, "Q": 3.53, "R": 52.0, "S": 1.67, "T": 1.66, "V": 0.13, "W": 2.1, "Y": 1.61}
FLEXIBILITY = {"A": 0.357, "C": 0.346, "D": 0.511, "E": 0.497, "F": 0.314, "G": 0.544, "H": 0.323, "I": 0.462, "K": 0.466, "L": 0.365, "M": 0.295, "N": 0.463, "P": 0.509, "Q": 0.493, "R": 0.529, "S": 0.507, "T": 0.444, "V": 0.386, "W": 0.305, "Y": 0.42}
HELIX = {"A": 1.42, "C": 0.7, "D": 1.01, "E": 1.51, "F": 1.13, "G": 0.57, "H": 1.0, "I": 1.08, "K": 1.16, "L": 1.21, "M": 1.45, "N": 0.67, "P": 0.57, "Q": 1.11, "R": 0.98, "S": 0.77, "T": 0.83, "V": 1.06, "W": 1.08, "Y": 0.69}
SHEET = {"A": 0.83, "C": 1.19, "D": 0.54, "E": 0.37, "F": 1.38, "G": 0.75, "H": 0.87, "I": 1.6, "K": 0.74, "L": 1.3, "M": 1.05, "N": 0.89, "P": 0.55, "Q": 1.1, "R": 0.93, "S": 0.75, "T": 1.19, "V": 1.7, "W": 1.37, "Y": 1.47}
TURN = {"A": 0.74, "C": 0.96, "D": 1.52, "E": 0.95, "F": 0.66, "G": 1.56, "H": 0.95, "I": 0.47, "K": 1.19, "L": 0.5, "M": 0.6, "N": 1.46, "P": 1.56, "Q": 0.96, "R": 1.01, "S": 1.43, "T": 0.98, "V": 0.59, "W": 0.6, "Y": 1.14}
CHARGE_PROXY = dict.fromkeys(RESIDUES, 0.0) | {"D": -1.0, "E": -1.0, "H": 0.5, "K": 1.0, "R": 1.0}

WATER = 18.015
PKA_N_TERM, PKA_C_TERM = 9.47, 2.1555
PKA_POSITIVE = {"H": 6.00, "K": 10.50, "R": 12.50}
PKA_NEGATIVE = {"C": 8.33, "D": 3.86, "E": 4.25, "Y": 10.07}

GROUPS = {
    "positive": "KRH",
    "negative": "DE",
    "charged": "KRHDE",
    "polar": "STNQCYWHKRDE",
    "nonpolar": "AVLIMFGP",
    "aromatic": "FWYH",
    "tiny": "AGCS",
    "small": "AGCSTVPDN",
    "sulfur": "CM",
    "hydroxyl": "STY",
    "amide": "NQ",
    "hydrophobic": "ILVMFYWHKCAT",
    "hydrophilic": "RNDQES",
    "disorder_promoting": "SAPREKG",
    "order_promoting": "CWYFILV",
}
DONORS, ACCEPTORS = "KRHWNQSTYDE", "DENQHSTY"
