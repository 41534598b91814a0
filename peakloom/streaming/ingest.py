"""Spectra as a stream: folders of Parquet shards read as they come, through the same stateless steps as in batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, source: str, files_per_trigger: int = 100) -> DataFrame:
    """New shards of a folder; the schema is that of the shards already there."""
    schema = spark.read.parquet(source).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)


def write_stream(df: DataFrame, target: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append to Parquet, each shard exactly once; `once` stops when what is there has been read."""
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start(target)


def run_once(spark: SparkSession, source: str, target: str, step: Callable[[DataFrame], DataFrame]) -> None:
    """Everything that is new in the source through the step into the target."""
    write_stream(step(read_stream(spark, source)), target, f"{target.rstrip('/')}-checkpoint", once=True).awaitTermination()


def run_rates(df: DataFrame, time: str, run: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Spectra of each run in each window of event time; rows later than the watermark are left out."""
    return df.withWatermark(time, late).groupBy(F.window(time, width), run).agg(F.count(F.lit(1)).alias("n_spectra"))
