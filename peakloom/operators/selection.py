"""The value at a rank, exactly, by counting passes over the bits of the values: no sort, and no task that holds more than its part."""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.operators.ordered import numbered
from peakloom.storage import removed, written

#: Bits that a pass counts by, and values that may come to the driver once no more are left to choose from.
DIGIT, FEW = 12, 50_000


def double_bits(value: Column) -> Column:
    """Doubles as integers of the same order; both zeros are one, NaN is last, null stays null."""

    @F.arrow_udf("long")
    def bits(values: pa.Array) -> pa.Array:
        numbers = values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
        raw = np.where(np.isnan(numbers), np.nan, numbers).view(np.int64)
        return pa.array(np.where(raw < 0, raw ^ np.int64(2**63 - 1), raw), mask=~values.is_valid().to_numpy(zero_copy_only=False))

    return bits(value)


def double_of(bits: int) -> float:
    """The double that double_bits() made an integer of."""
    raw = np.array([bits if bits >= 0 else bits ^ (2**63 - 1)], np.int64)
    return float(raw.view(np.float64)[0])


def at_ranks(df: DataFrame, value: Column, ranks: Sequence[int]) -> dict[int, tuple[int, int]]:
    """rank -> (value at that rank, from 1, in ascending order; how many values are smaller), for a column of integers without nulls.

    The bits that all values share are told by the smallest and the largest. Then a pass counts the values by their
    next DIGIT bits among those that share the bits known so far with a wanted value: at most len(ranks) * 2**DIGIT
    counts pass the driver, and in the end, where no more than FEW values share those bits, these values.
    """
    ranks = sorted(set(ranks))
    values = written(df.select(value.cast("long").alias("v")), "values")
    # The sign bit is turned over, so that the bits' order as unsigned numbers is that of the values.
    unsigned = F.col("v").bitwiseXOR(F.lit(-(2**63)).cast("long"))
    ends = values.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n")).first()
    if ranks and not 1 <= ranks[0] <= ranks[-1] <= ends["n"]:
        raise ValueError(f"there is no rank {ranks[-1] if ranks[0] > 0 else ranks[0]} among {ends['n']} values")
    low, high = ((ends[c] or 0) + 2**63 for c in ("low", "high"))
    left = (low ^ high).bit_length()
    known: dict[int, tuple[int, int]] = dict.fromkeys(ranks, (low >> left, 0))  # rank -> bits so far, number of values below them
    while left and ranks:
        step = min(DIGIT, left)
        prefix = F.shiftrightunsigned(unsigned, left) if left < 64 else F.lit(0).cast("long")
        digit = F.shiftrightunsigned(unsigned, left - step).bitwiseAND(F.lit(2**step - 1))
        wanted = [p if p < 2**63 else p - 2**64 for p in sorted({p for p, _ in known.values()})]
        some = values.where(prefix.isin(wanted)) if left < 64 else values
        counts: dict[int, list[tuple[int, int]]] = {}
        for r in some.groupBy(prefix.alias("p"), digit.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect():
            counts.setdefault(r["p"] % 2**64, []).append((r["d"], r["n"]))
        alike: dict[int, int] = {}
        for rank, (bits, below) in known.items():
            for d, n in sorted(counts.get(bits, [])):
                if below + n >= rank:
                    known[rank] = (bits << step | d, below)
                    alike[bits << step | d] = n
                    break
                below += n
        left -= step
        if left and sum(alike.values()) <= FEW:
            prefix = F.shiftrightunsigned(unsigned, left)
            found = sorted(r["v"] + 2**63 for r in values.where(prefix.isin([p if p < 2**63 else p - 2**64 for p in alike])).collect())
            for rank, (bits, below) in known.items():
                value = found[bisect.bisect_left(found, bits << left) + rank - below - 1]
                known[rank] = (value, below + bisect.bisect_left(found, value) - bisect.bisect_left(found, bits << left))
            left = 0
    removed(values)
    return {rank: ((bits ^ 2**63) - (2**64 if bits ^ 2**63 >= 2**63 else 0), below) for rank, (bits, below) in known.items()}


def smallest(df: DataFrame, keys: Sequence[Column], count: int) -> DataFrame:
    """The count rows of df that come first by integer keys, nulls first; of rows with all keys equal as many as there is room for.

    The last row's keys are found one after the other, each among the rows that are equal in those before.
    """
    if count <= 0:
        return df.limit(0)
    named = df.withColumns({f"__k{i}": F.struct(k.isNotNull().cast("long").alias("known"), F.coalesce(k.cast("long"), F.lit(0)).alias("v")) for i, k in enumerate(keys)})
    named = written(named, "keyed")
    parts = [F.col(f"__k{i}.{c}") for i in range(len(keys)) for c in ("known", "v")]
    if named.count() <= count:
        return named.select(*[F.col(f"`{c}`") for c in df.columns])
    before, equal, room = F.lit(False), F.lit(True), count
    for part in parts:
        last, below = at_ranks(named.where(equal), part, [room])[room]
        before, equal, room = before | (equal & (part < last)), equal & (part == last), room - below
    tied = numbered(named.where(equal), "__n").where(F.col("__n") < room).drop("__n")
    return named.where(before).unionByName(tied).select(*[F.col(f"`{c}`") for c in df.columns])
