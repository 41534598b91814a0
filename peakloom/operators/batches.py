"""Batches of lists of unequal length, as a model takes them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def padded(df: DataFrame, values: str, batch: str, fill: float = 0.0) -> DataFrame:
    """df with the lists of each batch filled up on the right to its longest, and mask: true where a value is padding.

    A batch's width is a window aggregate; batches are of bounded size, as a model takes them.
    """
    rows = df.withColumn("__size", F.size(values)).withColumn("__width", F.max("__size").over(Window.partitionBy(batch)))
    places = F.when(F.col("__width") > 0, F.sequence(F.lit(0), F.col("__width") - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("mask", F.transform(places, lambda i: i >= F.col("__size")))
    filled = F.concat(values, F.array_repeat(F.lit(fill), F.col("__width") - F.col("__size")))
    return rows.withColumn(values, filled).drop("__width", "__size")


def collated(peaks: list[tuple[np.ndarray, np.ndarray]], precursor_mz: np.ndarray, charge: np.ndarray, proton: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inside a task: spectra (n x peaks x 2), their mask (true: padding) and precursors (n x 3: mass, charge, m/z)."""
    width = max((len(m) for m, _ in peaks), default=0)
    spectra, mask = np.zeros((len(peaks), width, 2)), np.ones((len(peaks), width), bool)
    for k, (m, i) in enumerate(peaks):
        spectra[k, : len(m), 0], spectra[k, : len(m), 1], mask[k, : len(m)] = m, i, False
    return spectra, mask, np.stack(((precursor_mz - proton) * charge, charge, precursor_mz), axis=1)
