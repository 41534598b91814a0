"""Projections, schema checks and unions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.constants import COLUMN_TYPES, INDEX_COLUMNS, REQUIRED_COLUMNS
from peakloom.operators.ordered import running


def renamed(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Columns under their new names; names that df does not have are passed over."""
    return df.withColumnsRenamed(dict(mapping))


def coerced(df: DataFrame) -> DataFrame:
    """Known columns in their types; arrays that came as JSON text are parsed. A value that does not fit stops the job."""
    kinds = dict(df.dtypes)
    cast = {}
    for name, kind in COLUMN_TYPES.items():
        if name in kinds:
            text = kind.startswith("array") and kinds[name] == "string"
            cast[name] = F.from_json(name, kind) if text else F.col(name).cast(kind)
    return df.withColumns(cast) if cast else df


def preferred_sequence(df: DataFrame) -> DataFrame:
    """The modified sequence in place of the plain one where there is such a column."""
    return df.withColumn("sequence", F.col("modified_sequence")) if "modified_sequence" in df.columns else df


def identified(df: DataFrame, run: Column, ordinal: Column, scan: str = "scan_number") -> DataFrame:
    """df with experiment_name and spectrum_id: run and scan number, or run and ordinal without one."""
    number = F.col(scan) if scan in df.columns else ordinal
    return df.withColumn("experiment_name", run).withColumn("spectrum_id", F.concat_ws(":", run, number.cast("string")))


def file_stem(path: Column) -> Column:
    """A path's last part without its extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def missing_columns(df: DataFrame, annotated: bool = False) -> list[str]:
    need = [*REQUIRED_COLUMNS, *(["sequence"] if annotated else [])]
    return [c for c in need if c not in df.columns]


def check_columns(df: DataFrame, annotated: bool = False) -> DataFrame:
    """df itself, or an error at once if required columns are missing."""
    if gone := missing_columns(df, annotated):
        raise ValueError(f"Column(s) missing! Missing column(s): {', '.join(gone)}")
    return df


def annotation_state(df: DataFrame, sequence: str = "sequence", charge: str = "precursor_charge") -> DataFrame:
    """One row: n_rows, n_unannotated, all_annotated, charge_sum (0: charges are unknown)."""
    bare = F.col(sequence).isNull() | (F.col(sequence) == "")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(bare).alias("n_unannotated"), (F.count_if(bare) == 0).alias("all_annotated"),
        F.sum(charge).alias("charge_sum"),
    )


def with_prediction_ids(df: DataFrame, order: list[Column], name: str = "prediction_id") -> DataFrame:
    """df with dense ids from 0 in the order; no single task holds the table."""
    return running(df, order, rank=name).withColumn(name, (F.col(name) - 1).cast("int"))


def with_metadata(df: DataFrame, expected: dict[str, Column], metadata: tuple[str, ...] = ()) -> DataFrame:
    """The columns that a processing step makes, and metadata columns of df beside them, unchanged."""
    if gone := [c for c in metadata if c not in df.columns]:
        raise ValueError(f"Column(s) missing! Missing column(s): {', '.join(gone)}")
    return df.select(*[F.col(f"`{c}`") for c in metadata if c not in expected], *[v.alias(k) for k, v in expected.items()])


def index_columns(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    return df.select([c for c in (*INDEX_COLUMNS, *extra) if c in df.columns])


def union_relaxed(left: DataFrame, right: DataFrame) -> DataFrame:
    """All rows; columns that one side lacks are null there, types widen."""
    return left.unionByName(right, allowMissingColumns=True)


def union_strict(left: DataFrame, right: DataFrame) -> DataFrame:
    """All rows of two tables with the same columns and types."""
    if left.dtypes != right.dtypes:
        raise ValueError("the schemas differ")
    return left.unionByName(right)


def truncated(values: Column, keep: int = 3) -> Column:
    """A list's first and last values, for display; short lists as they are."""
    return F.when(F.size(values) > 2 * keep, F.concat(F.slice(values, 1, keep), F.slice(values, -keep, keep))).otherwise(values)


def flattened(config: Mapping, prefix: str = "") -> dict:
    """Nested keys as paths with dots."""
    out: dict = {}
    for key, value in config.items():
        path = f"{prefix}.{key}" if prefix else str(key)
        out |= flattened(value, path) if isinstance(value, Mapping) else {path: value}
    return out


def regions(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: how many different keys are in the left table alone, in both, in the right alone."""
    both = left.select(key).distinct().withColumn("l", F.lit(1)).join(right.select(key).distinct().withColumn("r", F.lit(1)), key, "full")
    return both.agg(
        F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("both"),
        F.count_if(F.col("l").isNull()).alias("right_only"),
    )
