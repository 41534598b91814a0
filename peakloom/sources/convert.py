"""The conversion job: spectra of any format into sharded Parquet."""

from __future__ import annotations

from pyspark.sql import SparkSession

from peakloom.sources import loader, sinks


def convert(
    spark: SparkSession, source: str | list[str], target: str, name: str, partition: str, max_charge: int = 10, shard_size: int = 1_000_000,
    annotated: bool = False, **options,
) -> list[str]:
    """Load spectra, keep those of at most max_charge, save them as shards; the shards' names. A null charge does not pass."""
    rows = loader.load_spectra(spark, source, annotated=annotated, **options)
    return sinks.write_sharded(rows.where(rows["precursor_charge"] <= max_charge), target, name, partition, shard_size)
