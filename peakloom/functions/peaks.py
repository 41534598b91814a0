"""Column functions on peak lists: arrays of (mz, intensity)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zipped(mz: Column, intensity: Column) -> Column:
    """Two parallel arrays as one array of (mz, intensity)."""
    return F.zip_with(mz, intensity, lambda m, i: F.struct(m.cast("double").alias("mz"), i.cast("double").alias("intensity")))


def in_window(peaks: Column, low: float, high: float) -> Column:
    return F.filter(peaks, lambda p: (p["mz"] >= low) & (p["mz"] <= high))


def without_precursor(peaks: Column, precursor_mz: Column, tolerance: float) -> Column:
    return F.filter(peaks, lambda p: F.abs(p["mz"] - precursor_mz) > tolerance)


def above(peaks: Column, floor: float) -> Column:
    return F.filter(peaks, lambda p: p["intensity"] >= floor)


def strongest(peaks: Column, k: int) -> Column:
    """The k strongest peaks, strongest first, ties by m/z; a list of no more than k peaks keeps its order."""
    keyed = F.transform(peaks, lambda p: F.struct((-p["intensity"]).alias("n"), p["mz"].alias("mz"), p["intensity"].alias("intensity")))
    top = F.transform(F.slice(F.array_sort(keyed), 1, k), lambda p: F.struct(p["mz"].alias("mz"), p["intensity"].alias("intensity")))
    return F.when(F.size(peaks) > k, top).otherwise(peaks)


def unit_norm(peaks: Column) -> Column:
    """Square roots of the intensities, scaled to length one."""
    whole = F.sqrt(F.aggregate(peaks, F.lit(0.0), lambda a, p: a + p["intensity"]))
    return F.transform(peaks, lambda p: F.struct(p["mz"].alias("mz"), (F.sqrt(p["intensity"]) / whole).alias("intensity")))


def processed(
    mz: Column, intensity: Column, precursor_mz: Column, low: float = 50.0, high: float = 2500.0, tolerance: float = 2.0,
    floor: float = 0.01, k: int = 200,
) -> Column:
    """All steps in order; a spectrum left without peaks becomes the one peak (0, 1)."""
    kept = above(without_precursor(in_window(zipped(mz, intensity), low, high), precursor_mz, tolerance), floor)
    dummy = F.array(F.struct(F.lit(0.0).alias("mz"), F.lit(1.0).alias("intensity")))
    return F.when(F.size(kept) > 0, unit_norm(strongest(kept, k))).otherwise(dummy)
