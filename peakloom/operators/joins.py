"""Joins and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.constants import NO_GROUP
from peakloom.operators.ordered import last_by

#: Bytes up to which a mapping is broadcast on request.
BROADCAST_BYTES = 32 << 20


def bounded_broadcast(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if the optimiser's estimate of its size is within bounds; else as it is."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= most else df


def spread_join(left: DataFrame, right: DataFrame, on: dict[str, str], spread: Column, how: str = "inner", salts: int = 16) -> DataFrame:
    """left joined with right (inner or left) where the columns of `on` are equal, null to null, whatever keys are hot on the left.

    right is broadcast within a checked size. Beyond it each of its rows is repeated for every salt, and left rows are
    dealt to the salts by `spread`, a column of left, so that the rows of one key meet in several tasks. The result
    has left's columns and right's without its keys; no other name may be in both.
    """
    right = right.withColumnsRenamed({b: f"__on_{b}" for b in on.values()})
    same = [F.col(f"`{a}`").eqNullSafe(F.col(f"`__on_{b}`")) for a, b in on.items()]
    small = bounded_broadcast(right)
    if small is not right:
        return left.join(small, same, how).drop(*[f"__on_{b}" for b in on.values()])
    dealt = left.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = right.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    joined = dealt.join(copies, [F.col("__salt") == F.col("__copy"), *same], how)
    return joined.drop("__salt", "__copy", *[f"__on_{b}" for b in on.values()])


def with_predictions(index: DataFrame, predictions: DataFrame, key: str = "prediction_id") -> DataFrame:
    """Every index row with its prediction, if there is one."""
    return index.join(predictions, key, "left")


def earlier_predictions(spectra: DataFrame, predictions: DataFrame, key: str, order: str, prediction: str, confidence: str | None = None) -> DataFrame:
    """spectra with input_predictions and input_log_probabilities.

    Of several predictions for a key the last in the order counts. Without one the prediction is empty and the
    confidence null; without a confidence column it is 0.
    """
    named = predictions.select(
        F.col(key), F.col(order).alias("__order"), F.col(prediction).alias("input_predictions"),
        (F.col(confidence) if confidence else F.lit(0.0)).alias("input_log_probabilities"),
    )
    last = last_by(named, [key], F.col("__order")).drop("__order")
    return spectra.join(last, key, "left").withColumn("input_predictions", F.coalesce("input_predictions", F.lit("")))


def with_group(df: DataFrame, mapping: DataFrame, key: str, group: str = "group") -> DataFrame:
    """df with the group of its key; no_group without one."""
    return df.join(bounded_broadcast(mapping.select(key, group)), key, "left").withColumn(group, F.coalesce(group, F.lit(NO_GROUP)))


def in_set(df: DataFrame, members: DataFrame, key: str) -> DataFrame:
    return df.join(members.select(key), key, "left_semi")


def not_in_set(df: DataFrame, members: DataFrame, key: str) -> DataFrame:
    return df.join(members.select(key), key, "left_anti")


def suffixed(left: DataFrame, right: DataFrame, key: str, suffixes: tuple[str, str] = ("_x", "_y"), how: str = "left") -> DataFrame:
    """A join in which columns that both sides have get suffixes."""
    both = (set(left.columns) & set(right.columns)) - {key}
    a = left.withColumnsRenamed({c: c + suffixes[0] for c in both})
    b = right.withColumnsRenamed({c: c + suffixes[1] for c in both})
    return a.join(b, key, how)


def band_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, width: float, inclusive: bool = False) -> DataFrame:
    """Pairs of rows whose values differ by less than width (or at most, if inclusive).

    Values fall into cells of that width; the right rows stand in their own cell and both neighbours, so that the
    join is an equality on cells with the difference checked after it.
    """
    a = left.withColumn("__cell", F.floor(F.col(left_on) / width).cast("bigint"))
    cell = F.floor(F.col(right_on) / width).cast("bigint")
    b = right.withColumn("__cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    gap = F.abs(F.col(left_on) - F.col(right_on))
    return a.join(b, "__cell").where(gap <= width if inclusive else gap < width).drop("__cell")


def range_join(values: DataFrame, ranges: DataFrame, value: str, low: str, high: str, cell: float) -> DataFrame:
    """Pairs of a value and a range that holds it, ends excluded; a range is spread over the cells it touches."""
    a = values.withColumn("__cell", F.floor(F.col(value) / cell).cast("bigint"))
    cells = F.sequence(F.floor(F.col(low) / cell).cast("bigint"), F.floor(F.col(high) / cell).cast("bigint"))
    b = ranges.where(F.col(low) < F.col(high)).withColumn("__cell", F.explode(cells))
    return a.join(b, "__cell").where((F.col(value) > F.col(low)) & (F.col(value) < F.col(high))).drop("__cell")


def keep_unrefined(refined_match: Column, refined_log_prob: Column, earlier_match: Column, earlier_log_prob: Column, threshold: float = 0.9) -> Column:
    """Whether an earlier prediction stands: it is unsure, it alone meets the precursor, and it is likelier."""
    return (
        (earlier_log_prob < F.log(F.lit(threshold))) & (earlier_match.cast("int") > refined_match.cast("int")) & (earlier_log_prob > refined_log_prob)
    )


def two_stage(first: DataFrame, second: DataFrame, key: str, prefixes: tuple[str, str] = ("first_", "second_"), final: tuple[str, ...] = ("predictions", "log_prob")) -> DataFrame:
    """Outputs of a prediction and of its refinement side by side, each under its prefix, and the refinement's once more without one."""
    a = first.select(key, *[F.col(c).alias(prefixes[0] + c) for c in first.columns if c != key])
    b = second.select(key, *[F.col(c).alias(prefixes[1] + c) for c in second.columns if c != key])
    return a.join(b, key, "left").withColumns({c: F.col(prefixes[1] + c) for c in final})
