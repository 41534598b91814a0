"""Samples, shuffles, splits and shards."""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.operators import selection
from peakloom.operators.ordered import numbered, running


def sample_bernoulli(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Each row on its own with the given chance."""
    check_fraction(fraction)
    return df.sample(fraction=fraction, seed=seed)


def sample_exact(df: DataFrame, fraction: float, key: Column, seed: int = 42) -> DataFrame:
    """floor(rows * fraction) rows without replacement: those whose integer key has the smallest hash, equal hashes by key.

    The same rows at any time and on any cluster; of rows with one key as many as there is room for.
    """
    check_fraction(fraction)
    return selection.smallest(df, [hash_of(key, seed), key], int(df.count() * fraction))


def subset_of(df: DataFrame, fraction: float, key: Column, seed: int = 42) -> DataFrame:
    """The rows that a job is to work on: all of them for a fraction of 1, else an exact sample. A fraction outside (0, 1] and an empty table are errors at once."""
    check_fraction(fraction)
    if df.isEmpty():
        raise ValueError("no data found")
    return df if fraction == 1 else sample_exact(df, fraction, key, seed)


def hash_of(key: Column, seed: int = 0) -> Column:
    """An integer below 2**31 - 1 that depends on an integer key alone, the same in every engine."""
    return F.pmod(F.pmod(key * 48271 + seed, F.lit(2147483647)) * 69621, F.lit(2147483647))


def check_fraction(fraction: float) -> None:
    if not 0 < fraction <= 1:
        raise ValueError(f"a fraction is above 0 and at most 1, not {fraction}")


def share_of(key: Column, seed: int = 0) -> Column:
    """An integer from 0 to 999,999 that depends on an integer key alone."""
    return hash_of(key, seed) % 1000000


def sample_by_key(df: DataFrame, key: Column, fraction: float, seed: int = 0) -> DataFrame:
    """Rows whose key falls into the fraction; the same keys at any time and on any cluster."""
    check_fraction(fraction)
    return df.where(share_of(key, seed) < int(fraction * 1000000))


def text_key(text: Column) -> Column:
    """A string as an integer, the same in every engine with MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("long")


def split_by_group(df: DataFrame, group: Column, valid_fraction: float, seed: int = 0) -> DataFrame:
    """df with split: train or valid. Rows of one group (a string) fall on one side."""
    check_fraction(valid_fraction)
    return df.withColumn("split", F.when(share_of(text_key(group), seed) < int(valid_fraction * 1000000), "valid").otherwise("train"))


def permuted(row: Column, rows: int, seed: int = 42, rounds: int = 6) -> Column:
    """A row number's place in a permutation of 0 to rows - 1 that depends on the seed alone.

    A Feistel network over the smallest even number of bits that holds all numbers; a place outside the range is sent
    through again until it falls inside, which keeps the map one to one.
    """
    half = max(1, (max(1, rows - 1).bit_length() + 1) // 2)
    keys = [(seed * 7919 + r * 104729 + 1) % 2147483647 for r in range(rounds)]

    @F.arrow_udf("long")
    def place(numbers: pa.Array) -> pa.Array:
        x = numbers.to_numpy(zero_copy_only=False).astype(np.int64)
        out, todo = x.copy(), np.arange(len(x))
        while len(todo):
            left, right = out[todo] >> half, out[todo] & ((1 << half) - 1)
            for k in keys:
                mixed = (right * 48271 + k) % 2147483647 * 69621 % 2147483647
                left, right = right, left ^ (mixed & ((1 << half) - 1))
            out[todo] = left << half | right
            todo = todo[out[todo] >= rows]
        return pa.array(out)

    return place(row)


def shuffled(df: DataFrame, sizes: Sequence[int], seed: int = 42, order: list[Column] | None = None) -> DataFrame:
    """df with shard and place: all rows in one random order, dealt to shards of the given sizes, which must sum to the rows.

    Rows are numbered as they come, or in the order, which should be total; the place of a number is a keyed bijection,
    so that a task that runs twice gives its rows the same places.
    """
    rows = numbered(df, "__row") if order is None else running(df, order, rank="__row").withColumn("__row", F.col("__row") - 1)
    ends = np.cumsum(np.asarray(sizes, np.int64))
    total = int(ends[-1]) if len(ends) else 0

    @F.arrow_udf("long")
    def shard_of(places: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(ends, places.to_numpy(zero_copy_only=False), "right"))

    @F.arrow_udf("long")
    def begin_of(shards: pa.Array) -> pa.Array:
        return pa.array(np.append(0, ends)[shards.to_numpy(zero_copy_only=False)])

    where = F.when(F.col("__row") < total, F.col("__row")).otherwise(F.raise_error(F.lit(f"the shards have {total} rows in all, the table more")).cast("long"))
    placed = rows.withColumn("__place", permuted(where, total, seed)).withColumn("shard", shard_of(F.col("__place")))
    return placed.withColumn("place", F.col("__place") - begin_of(F.col("shard"))).drop("__row", "__place")


def shuffle_rows(df: DataFrame, seed: int = 42) -> DataFrame:
    """All rows in one random order, in as many partitions as there are now, of equal size."""
    return shuffle_shards(df, max(1, df.rdd.getNumPartitions()), seed)


def shuffle_shards(df: DataFrame, shards: int, seed: int = 42) -> DataFrame:
    """All rows in one random order, dealt to shards of equal size, each a run of sorted places in a partition."""
    count = df.count()
    sizes = [count // shards + (k < count % shards) for k in range(shards)]
    placed = shuffled(df, sizes, seed).repartition(shards, "shard").sortWithinPartitions("shard", "place")
    return placed.select(*[F.col(f"`{c}`") for c in df.columns])


def buffered(df: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """The rows of each partition in the order of a shuffle buffer: once it holds size rows, each further row takes the place of one drawn at random, which leaves; the rest leaves shuffled.

    Works on a table and on a stream, whose batches each have their own buffers. The draws depend on the seed and the
    partition's number, so that a task that runs twice gives the same order. A task holds size rows and a batch.
    """
    if size < 1:
        raise ValueError("a buffer holds a row at least")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = random.Random(f"{seed}/{TaskContext.get().partitionId()}")
        held, kinds = None, None
        for batch in batches:
            kinds = batch.schema
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            first = 0 if held is None else held.num_rows
            slots, out = list(range(first)), []
            for i in range(first, table.num_rows):
                if len(slots) < size:
                    slots.append(i)
                else:
                    j = draw.randrange(size)
                    out.append(slots[j])
                    slots[j] = i
            if out:
                yield from table.take(pa.array(out)).combine_chunks().to_batches()
            held = table.take(pa.array(slots, pa.int64())).combine_chunks()
        if held is not None and held.num_rows:
            order = list(range(held.num_rows))
            draw.shuffle(order)
            yield from held.take(pa.array(order)).cast(kinds).combine_chunks().to_batches()

    return df.mapInArrow(rows, df.schema)


def sharded(df: DataFrame, order: list[Column], most: int) -> DataFrame:
    """df with shard and place: runs of at most `most` rows in the order."""
    rows = running(df, order, rank="__rank")
    at = F.col("__rank") - 1
    return rows.withColumn("shard", F.floor(at / most)).withColumn("place", at % most).drop("__rank")
