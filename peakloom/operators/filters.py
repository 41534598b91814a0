"""Row filters and checks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_rows(df: DataFrame, predicate: Column | str | Callable[[dict], object]) -> DataFrame:
    """Rows that a condition holds for: a column, SQL, or a function of a row as a dict, which is called in tasks and Spark cannot push down."""
    if isinstance(predicate, (Column, str)):
        return df.where(predicate)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([bool(predicate(row)) for row in batch.to_pylist()], pa.bool_()))

    return df.mapInArrow(rows, df.schema)


def outside(df: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Rows with a value outside the bounds; a missing bound bounds nothing, nulls pass."""
    out = F.lit(False)
    if low is not None:
        out = out | (F.col(column) < low)
    if high is not None:
        out = out | (F.col(column) > high)
    return df.where(out)


def values_within(df: DataFrame, column: str, low: float | None = None, high: float | None = None) -> bool:
    """Whether no value is outside the bounds; stops at the first that is."""
    return outside(df, column, low, high).isEmpty()


def by_charge(df: DataFrame, most: int, charge: str = "precursor_charge") -> DataFrame:
    """Rows with a known charge of at most `most`."""
    return df.where((F.col(charge) > 0) & (F.col(charge) <= most))


def by_vocabulary(df: DataFrame, tokens: str, supported: Iterable[str]) -> DataFrame:
    """Rows whose tokens are all supported."""
    return df.where(F.size(F.array_except(tokens, F.array(*[F.lit(t) for t in supported]))) == 0)


def blank_unless(df: DataFrame, column: str, condition: Column) -> DataFrame:
    """df with an empty string in the column where the condition fails; rows stay."""
    return df.withColumn(column, F.when(condition, F.col(column)).otherwise(F.lit("")))


def precursor_check(df: DataFrame, matched: Column) -> DataFrame:
    """One row: n_rows and n_matched."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(matched).alias("n_matched"))


def require_precursor_matches(df: DataFrame, matched: Column) -> int:
    """How many rows match their precursor; an error if none does."""
    row = precursor_check(df, matched).first()
    if not row["n_matched"]:
        raise ValueError("no sequence matches its precursor mass")
    return row["n_matched"]
