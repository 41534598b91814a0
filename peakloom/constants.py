"""Physical constants, residue masses, name maps and column types."""

from __future__ import annotations

H2O_MASS = 18.0106
CARBON_MASS_DELTA = 1.00335
PROTON_MASS = 1.007276
MASS_SCALE = 10000
MAX_MASS = 4000.0
MAX_SEQUENCE_LENGTH = 200

PAD, SOS, EOS = "[PAD]", "[SOS]", "[EOS]"
SPECIAL_TOKENS = (PAD, SOS, EOS)
NO_GROUP = "no_group"

# Monoisotopic residue masses in dalton.
AMINO_ACIDS = {
    "G": 57.021464, "A": 71.037114, "S": 87.032028, "P": 97.052764, "V": 99.068414, "T": 101.047670, "C": 103.009185,
    "L": 113.084064, "I": 113.084064, "N": 114.042927, "D": 115.026943, "Q": 128.058578, "K": 128.094963,
    "E": 129.042593, "M": 131.040485, "H": 137.058912, "F": 147.068414, "R": 156.101111, "Y": 163.063329, "W": 186.079313,
}
MODIFIED_RESIDUES = {
    "M[UNIMOD:35]": 147.035400, "C[UNIMOD:4]": 160.030649, "N[UNIMOD:7]": 115.026943, "Q[UNIMOD:7]": 129.042594,
    "R[UNIMOD:7]": 157.085127, "P[UNIMOD:35]": 113.047679, "S[UNIMOD:21]": 166.998028, "T[UNIMOD:21]": 181.01367,
    "Y[UNIMOD:21]": 243.029329, "[UNIMOD:1]": 42.010565, "[UNIMOD:5]": 43.005814, "[UNIMOD:385]": -17.026549,
}
RESIDUE_MASSES = AMINO_ACIDS | MODIFIED_RESIDUES

# Other spellings of modified residues.
RESIDUE_REMAPPING = {
    "M(ox)": "M[UNIMOD:35]", "M(+15.99)": "M[UNIMOD:35]", "S(p)": "S[UNIMOD:21]", "T(p)": "T[UNIMOD:21]",
    "Y(p)": "Y[UNIMOD:21]", "S(+79.97)": "S[UNIMOD:21]", "T(+79.97)": "T[UNIMOD:21]", "Y(+79.97)": "Y[UNIMOD:21]",
    "Q(+0.98)": "Q[UNIMOD:7]", "N(+0.98)": "N[UNIMOD:7]", "Q(+.98)": "Q[UNIMOD:7]", "N(+.98)": "N[UNIMOD:7]",
    "C(+57.02)": "C[UNIMOD:4]", "R(+0.984016)": "R[UNIMOD:7]", "P(+15.994915)": "P[UNIMOD:35]",
    "(+42.01)": "[UNIMOD:1]", "(+43.01)": "[UNIMOD:5]", "(-17.03)": "[UNIMOD:385]",
}

# Types of the known columns, and other programs' names for them.
COLUMN_TYPES = {
    "mz_array": "array<double>", "intensity_array": "array<double>", "precursor_mz": "double", "precursor_charge": "bigint",
    "precursor_mass": "double", "retention_time": "double",
}
REQUIRED_COLUMNS = ("mz_array", "intensity_array", "precursor_mz", "precursor_charge")
COLUMN_MAP = {
    "Modified sequence": "modified_sequence", "MS/MS m/z": "precursor_mz", "Mass": "precursor_mass", "Charge": "precursor_charge",
    "Mass values": "mz_array", "Mass spectrum": "mz_array", "Intensity": "intensity_array",
    "Raw intensity spectrum": "intensity_array", "Scan number": "scan_number",
}
LEGACY_COLUMNS = {
    "Sequence": "sequence", "Modified sequence": "modified_sequence", "MS/MS m/z": "precursor_mz", "Charge": "precursor_charge",
    "Mass values": "mz_array", "Intensity": "intensity_array",
}

# Columns that identify a spectrum in outputs.
INDEX_COLUMNS = (
    "id", "experiment_name", "evidence_index", "scan_number", "spectrum_id", "global_index", "spectrum_index", "file_index", "sample", "file",
    "index", "fileno", "precursor_mz", "precursor_charge",
)

# Fixed value: a standalone modification, or a residue with one.
_MOD = r"\[[^\]]+\]|\([^)]+\)|[+-]?\d+(?:\.\d+)?|[+-]?\.\d+"
TOKEN_PATTERN = rf"(?:{_MOD})|[A-Z](?:{_MOD})?"
