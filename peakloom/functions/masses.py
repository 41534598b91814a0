"""Column functions on masses, m/z and mass errors."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from peakloom.constants import CARBON_MASS_DELTA, H2O_MASS, MASS_SCALE, PROTON_MASS, RESIDUE_MASSES
from peakloom.functions.tokens import map_of


def masses(tokens: Column, table: Mapping[str, float] = RESIDUE_MASSES, strict: bool = True) -> Column:
    """Mass of each token. An unknown token stops the job, or has no mass if not strict."""
    lookup = map_of(table)
    one = lambda t: F.try_element_at(lookup, t)
    if strict:
        return F.transform(tokens, lambda t: F.coalesce(one(t), F.raise_error(F.concat(F.lit("unknown residue "), t)).cast("double")))
    return F.transform(tokens, one)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, m: a + m)


def running(values: Column) -> Column:
    """The sum of each value and those before it in its list; nulls add nothing, and are null where nothing came before."""
    empty = F.array().cast("array<double>")
    return F.aggregate(values, empty, lambda a, m: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1) + m, F.get(a, F.size(a) - 1), m))))


def sequence_mass(tokens: Column, charge: Column | None = None, table: Mapping[str, float] = RESIDUE_MASSES) -> Column:
    """Mass with water; m/z where there is a charge other than zero."""
    mass = total(masses(tokens, table)) + H2O_MASS
    if charge is None:
        return mass
    return F.when(charge.isNotNull() & (charge != 0), mass / F.nullif(charge, F.lit(0)) + PROTON_MASS).otherwise(mass)


def precursor_mass(mz: Column, charge: Column) -> Column:
    """Neutral mass as readers derive it."""
    return mz * charge - charge * PROTON_MASS


def precursor_mass_batched(mz: Column, charge: Column) -> Column:
    """Neutral mass as batches derive it; equal but for rounding."""
    return (mz - PROTON_MASS) * charge


def ppm_error(theoretical: Column, measured: Column, charge: Column, isotope: Column | int = 0) -> Column:
    """Mass error in parts per million, the measured m/z shifted by some isotopes; null for charge 0."""
    k = F.lit(isotope) if isinstance(isotope, int) else isotope
    shift = k * F.lit(CARBON_MASS_DELTA) / F.nullif(charge, F.lit(0))
    return (theoretical - (measured - shift)) / measured * 1e6


def isotope_range(given: int | tuple[int, int] | list[int] | None = None) -> tuple[int, int]:
    """The first and last number of isotopes: 0 and 1 by default, 0 and n for a number, a pair as it is."""
    if given is None:
        return 0, 1
    return (0, given) if isinstance(given, int) else (given[0], given[1])


def ppm_errors(theoretical: Column, measured: Column, charge: Column, isotopes: tuple[int, int] = (0, 1)) -> Column:
    """The errors for each number of isotopes in the range, both ends included."""
    return F.array(*[ppm_error(theoretical, measured, charge, k) for k in range(isotopes[0], isotopes[1] + 1)])


def matches_precursor(theoretical: Column, measured: Column, charge: Column, tolerance: float = 50, isotopes: tuple[int, int] = (0, 1)) -> Column:
    """Whether some isotope's error is within the tolerance; false where there is no sequence."""
    errors = ppm_errors(theoretical, measured, charge, isotopes)
    return F.coalesce(F.exists(errors, lambda d: F.abs(d) < tolerance), F.lit(False))


def delta_mass_ppm(theoretical: Column, measured: Column, charge: Column, isotopes: tuple[int, int] = (0, 1)) -> Column:
    """The smallest absolute error over the isotopes."""
    return F.array_min(F.transform(ppm_errors(theoretical, measured, charge, isotopes), F.abs))


def scaled(mass: Column, scale: int = MASS_SCALE) -> Column:
    """Mass as an integer, halves to even."""
    return F.bround(mass * scale, 0).cast("bigint")


def meets_precursor_mass(remaining: Column, mass: Column, tolerance: float = 5e-5, max_isotope: int = 1) -> Column:
    """Whether what remains of the precursor's mass is some isotopes, within a share of that mass."""
    hits = [F.abs(remaining - k * CARBON_MASS_DELTA) < tolerance * mass for k in range(max_isotope + 1)]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out
