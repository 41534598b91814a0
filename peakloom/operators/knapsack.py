"""Which masses residues can add up to, and which residues can come last.

The chart of masses by residues follows from one bit per mass: a mass is
reachable with residue r last if the mass without r is reachable or a seed. The
bits, with the counts of each word of them, are some megabytes at any number of spectra;
they are built once, can be saved and loaded, and go to each executor once, as a broadcast.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.constants import CARBON_MASS_DELTA, MASS_SCALE, MAX_MASS, RESIDUE_MASSES
from peakloom.operators.joins import range_join


@dataclass(frozen=True)
class Knapsack:
    """residues, and one bit for each scaled mass, whether it is reachable: `words` of 64 bits, lowest first, for `size` masses."""

    max_mass: float
    scale: int
    max_isotope: int
    residues: tuple[str, ...]
    words: np.ndarray
    size: int

    @classmethod
    def of(cls, max_mass: float, scale: int, max_isotope: int, residues: tuple[str, ...], reach: np.ndarray) -> Knapsack:
        """A knapsack of an array of booleans."""
        packed = np.packbits(reach, bitorder="little")
        return cls(max_mass, scale, max_isotope, residues, np.append(packed, np.zeros(-len(packed) % 8, np.uint8)).view("<u8"), len(reach))

    @property
    def reach(self) -> np.ndarray:
        return np.unpackbits(self.words.view(np.uint8), count=self.size, bitorder="little").astype(bool)

    @property
    def masses(self) -> np.ndarray:
        """Reachable scaled masses, ascending."""
        return np.flatnonzero(self.reach)

    def feasible(self, target: float, tolerance: float) -> np.ndarray:
        """Reachable scaled masses strictly between the rounded ends of target +- tolerance."""
        low, high = round(self.scale * (target - tolerance)), round(self.scale * (target + tolerance))
        at, end = min(self.size, max(0, low + 1)), min(self.size, max(0, high))
        first = at >> 6
        bits = np.unpackbits(self.words[first : (end + 63) >> 6].view(np.uint8), bitorder="little")
        return at + np.flatnonzero(bits[at - 64 * first : end - 64 * first])

    @cached_property
    def ranks(self) -> np.ndarray:
        """How many masses below each word's first are reachable."""
        return np.append(0, np.cumsum(np.bitwise_count(self.words), dtype=np.int32))

    def below(self, mass: np.ndarray) -> np.ndarray:
        """How many reachable masses are below each scaled mass, which is cut to those that there are; an interval has one if its ends differ."""
        at = np.clip(mass, 0, self.size)
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        part = np.append(self.words, np.uint64(0))[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.ranks[word] + np.bitwise_count(part)


def build(table: Mapping[str, float] = RESIDUE_MASSES, max_mass: float = MAX_MASS, scale: int = MASS_SCALE, max_isotope: int = 2) -> Knapsack:
    """All sums of residues up to max_mass, a first residue shifted by isotopes and by residues of negative mass.

    Adding any number of one residue is a prefix "or" along strides of its mass. One pass over the residues yields
    every multiset of them, since a sum does not depend on their order.
    """
    size = round(max_mass * scale) + 1
    steps = sorted({round(m * scale) for m in table.values() if m > 0})
    lost = [0.0, *[m for m in table.values() if m < 0]]
    reach = np.zeros(size, bool)
    for step in steps:
        for shift in lost:
            for isotope in range(max_isotope + 1):
                at = step + round((CARBON_MASS_DELTA * isotope + shift) * scale)
                if 0 <= at < size:
                    reach[at] = True
    for step in steps:
        rows = -(-size // step)
        padded = np.zeros(rows * step, bool)
        padded[:size] = reach
        reach = np.logical_or.accumulate(padded.reshape(rows, step), axis=0).ravel()[:size]
    return Knapsack.of(max_mass, scale, max_isotope, tuple(table), reach)


def save(spark: SparkSession, knapsack: Knapsack, path: str) -> None:
    """The masses and parameters as Parquet; an existing path is an error."""
    meta = json.dumps({"max_mass": knapsack.max_mass, "scale": knapsack.scale, "max_isotope": knapsack.max_isotope, "residues": knapsack.residues})
    spark.createDataFrame(pa.table({"mass": knapsack.masses})).withColumn("meta", F.lit(meta)).write.mode("errorifexists").parquet(path)


def load(spark: SparkSession, path: str) -> Knapsack:
    rows = spark.read.parquet(path)
    meta = json.loads(rows.select("meta").first()["meta"])
    reach = np.zeros(round(meta["max_mass"] * meta["scale"]) + 1, bool)
    reach[rows.select("mass").toPandas()["mass"].to_numpy()] = True
    return Knapsack.of(meta["max_mass"], meta["scale"], meta["max_isotope"], tuple(meta["residues"]), reach)


def feasible(masses: DataFrame, targets: DataFrame, target: str, tolerance: float, scale: int = MASS_SCALE) -> DataFrame:
    """Each row of targets with each scaled mass (column mass) strictly within its rounded interval."""
    ends = targets.withColumns({
        "__lo": F.bround((F.col(target) - tolerance) * scale, 0).cast("bigint"), "__hi": F.bround((F.col(target) + tolerance) * scale, 0).cast("bigint"),
    })
    return range_join(masses, ends, "mass", "__lo", "__hi", 2 * tolerance * scale).drop("__lo", "__hi")
