"""Ranks and running sums over a whole table without a window in one task."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakloom.storage import written


def running(df: DataFrame, order: list[Column], sums: dict[str, Column] | None = None, rank: str = "rank", by: str | None = None) -> DataFrame:
    """df with its rank (from 1) in the order and running sums up to each row; within each group where there is `by`.

    Rows are range-partitioned by the order and written once with their partition's number, so that totals and ranks
    come from the same partitions whatever the optimiser makes of the plan, and whatever executor is lost. Ranks and
    sums within a partition then start at the totals of the partitions before it, of which there is one row for each
    partition (and group that it holds). The order should be total. Of a group whose name is null the rows are ranked
    as those of any other.
    """
    sums = sums or {}
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys, order = (["__by"], [F.col("__by"), *order]) if by is not None else ([], order)
    named = df.withColumn("__by", F.struct(by)) if by is not None else df
    ranged = named.withColumns({f"__{k}": v for k, v in sums.items()}).repartitionByRange(parts, *order)
    ranged = written(ranged.withColumn("__part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("__part", *keys).agg(F.count(F.lit(1)).alias("__n"), *[F.sum(f"__{k}").alias(f"__s_{k}") for k in sums])
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    base = totals.select(
        "__part", *keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__b"),
        *[F.coalesce(F.sum(f"__s_{k}").over(before), F.lit(0)).alias(f"__b_{k}") for k in sums],
    )
    inside = Window.partitionBy("__part", *keys).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({rank: F.row_number().over(inside), **{k: F.sum(f"__{k}").over(upto) for k in sums}})
    out = local.join(F.broadcast(base), ["__part", *keys])
    out = out.withColumns({rank: F.col(rank) + F.col("__b"), **{k: F.col(k) + F.col(f"__b_{k}") for k in sums}})
    return out.select(*df.columns, rank, *sums)


def numbered(df: DataFrame, name: str = "row") -> DataFrame:
    """df with dense row numbers from 0, in the order of partitions and of rows within them: no sort and no shuffle.

    The rows are written once with their partition and place, so that a lost task changes no number. Of the partitions
    there is one count each.
    """
    parts = written(df.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33)  # the place in the partition is below
    counts = parts.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    base = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    placed = parts.withColumn("__part", part).join(F.broadcast(base), "__part")
    number = F.col("__base") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn(name, number).select(*[F.col(f"`{c}`") for c in df.columns], name)


def moving_average(df: DataFrame, order: list[Column], value: str, decay: float = 0.99, name: str = "average") -> DataFrame:
    """df with the exponential moving average of a column up to each row: the first value, then decay * average + (1 - decay) * value.

    A null, NaN or infinite value is an error, as in a running loss. A step is an affine map of the average before it, and
    maps compose: each range partition is reduced to one map, the maps' composition gives every partition its start, and
    the rows follow from there. The order should be total.
    """
    bad = F.col(value).isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    checked = df.withColumn("__v", F.when(bad, F.raise_error(F.lit(f"{value} has an invalid value"))).otherwise(F.col(value).cast("double")))
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(checked.repartitionByRange(count, *order).withColumn("__part", F.spark_partition_id()), "ranged")
    placed = ranged.withColumn("__i", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))

    def scanned(start: dict[int, float] | None):
        def rows(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("__i")
            part, values = int(frame["__part"].iloc[0]), frame["__v"].to_numpy()
            begins = start is None or start.get(part) is None
            average = values[0] if begins else decay * start[part] + (1 - decay) * values[0]
            out = [average]
            for v in values[1:]:
                average = decay * average + (1 - decay) * v
                out.append(average)
            if start is None:
                return pd.DataFrame({"__part": [part], "n": [len(values)], "first": [values[0]], "last": [average]})
            return frame.assign(**{name: out}).drop(columns=["__v", "__part", "__i"])

        return rows

    slim = placed.select("__part", "__i", "__v")
    maps = slim.groupBy("__part").applyInPandas(scanned(None), "__part int, n long, first double, last double").orderBy("__part").collect()  # a row for each partition
    starts, before = {}, None
    for m in maps:
        starts[m["__part"]] = before
        # The map of a partition is known from the average that its first value alone would start.
        before = m["last"] if before is None else m["last"] + decay ** (m["n"] - 1) * (decay * before + (1 - decay) * m["first"] - m["first"])
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])
    return placed.groupBy("__part").applyInPandas(scanned(starts), schema)


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def last_by(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The row with the largest order of each key, by aggregation, which a hot key does not slow down."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__row"))
    return picked.select(*keys, "__row.*")


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each key with their rank; partial limits run before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def padded_beams(beams: Column, n: int, empty: Column) -> Column:
    """The first n of an array of beams, filled up with an empty beam."""
    return F.concat(F.slice(beams, 1, n), F.array_repeat(empty, F.greatest(F.lit(0), F.lit(n) - F.size(beams))))
