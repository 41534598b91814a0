"""Writers of spectra, predictions and encodings."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.operators.ordered import numbered
from peakloom.operators.schema import union_relaxed
from peakloom.sources import ipc, ranges


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, jvm.org.apache.hadoop.fs.Path


def write_sharded(df: DataFrame, target: str, name: str, partition: str, most: int = 1_000_000) -> list[str]:
    """Parquet files dataset-{name}-{partition}-{i:04d}-{n:04d}.parquet, all of `most` rows but the last; their names. Rows keep their order.

    Rows are numbered where they are; those of one shard then meet in one task, so that what is left over in a partition
    fills up the next one's shard. Spark writes the files into a folder beside the others, and they are moved to their
    names once all are there. Without a row there is one file with the schema.
    """
    fs, _, path = _fs(df.sparkSession, target)
    aside = f"{target.rstrip('/')}/.staged-{uuid.uuid4().hex}"
    rows = numbered(df, "__row")
    shards = -(-rows.count() // most)
    if shards:
        dealt = rows.withColumn("__shard", F.floor(F.col("__row") / most).cast("int")).repartition(shards, "__shard")
        dealt.sortWithinPartitions("__shard", "__row").drop("__row").write.partitionBy("__shard").parquet(aside)
        folders = [f"{aside}/__shard={i}" for i in range(shards)]
    else:
        df.limit(0).coalesce(1).write.parquet(aside)
        folders = [aside]
    names = [f"dataset-{name}-{partition}-{i:04d}-{len(folders):04d}.parquet" for i in range(len(folders))]
    for folder, to in zip(folders, names, strict=True):
        (part,) = [s.getPath() for s in fs.listStatus(path(folder)) if s.getPath().getName().startswith("part-")]
        fs.rename(part, path(f"{target.rstrip('/')}/{to}"))
    fs.delete(path(aside), True)
    return names


def with_text_arrays(df: DataFrame) -> DataFrame:
    """Array columns as JSON text."""
    return df.withColumns({f.name: F.to_json(f.name) for f in df.schema if f.dataType.typeName() == "array"})


def write_csv(df: DataFrame, target: str, mode: str = "overwrite") -> None:
    """A folder of CSV files with headers; arrays as JSON text."""
    with_text_arrays(df).write.mode(mode).option("header", True).option("escape", '"').csv(target)


def write_predictions(df: DataFrame, target: str, by_group: bool = False) -> None:
    """Predictions as CSV, in a folder for each group if asked for."""
    writer = with_text_arrays(df).write.mode("overwrite").option("header", True).option("escape", '"')
    (writer.partitionBy("group") if by_group else writer).csv(target)


def write_split_manifest(df: DataFrame, target: str, group: str, split: str = "split") -> None:
    """A folder of CSV files with each different group once and the side of the split it falls on."""
    df.select(group, split).distinct().write.mode("overwrite").option("header", True).csv(target)


def append_metrics(rows: DataFrame, target: str) -> None:
    """The rows of a metrics table added to those at the target; columns that either lacks are null there."""
    fs, at, path = _fs(rows.sparkSession, target)
    if fs.exists(at):
        rows = union_relaxed(rows.sparkSession.read.option("header", True).option("inferSchema", True).csv(target), rows)
    aside = f"{target.rstrip('/')}-{uuid.uuid4().hex}"
    rows.coalesce(1).write.option("header", True).csv(aside)  # a table of metrics is a few rows
    fs.delete(at, True)
    fs.rename(path(aside), at)


def write_ipc(df: DataFrame, target: str, mode: str = "append") -> list[str]:
    """A folder of Arrow IPC files, committed as a whole; the uris of all files that are in it then."""
    ipc.save(df, target, mode)
    return [uri for uri, _ in ranges.listed(df.sparkSession, target)]


def mgf_block(df: DataFrame) -> Column:
    """A spectrum as an MGF block; fields that df lacks or that are null are left out."""

    def line(name: str, column: str, text: Column | None = None) -> Column:
        if column not in df.columns:
            return F.lit("")
        return F.coalesce(F.concat(F.lit(f"{name}="), (F.col(column).cast("string") if text is None else text), F.lit("\n")), F.lit(""))

    charge = F.concat(F.abs("precursor_charge").cast("string"), F.when(F.col("precursor_charge") < 0, "-").otherwise("+"))
    peaks = F.zip_with("mz_array", "intensity_array", lambda m, i: F.concat(m.cast("string"), F.lit(" "), i.cast("string")))
    return F.concat(
        F.lit("BEGIN IONS\n"), line("TITLE", "spectrum_id"), line("PEPMASS", "precursor_mz"), line("CHARGE", "precursor_charge", charge),
        line("SCANS", "scan_number"), line("RTINSECONDS", "retention_time"), line("SEQ", "sequence"),
        F.array_join(peaks, "\n"), F.when(F.size("mz_array") > 0, "\n").otherwise(""), F.lit("END IONS\n"),
    )


def write_mgf(df: DataFrame, target: str) -> None:
    """A folder of MGF files, replacing what is there; rows keep their order within a file."""
    df.select(mgf_block(df).alias("value")).write.mode("overwrite").text(target)


def write_fasta(df: DataFrame, target: str, id_col: str, sequence_col: str) -> None:
    """A folder of FASTA files, sequences on one line; a null sequence is empty."""
    entry = F.concat(F.lit(">"), F.col(id_col).cast("string"), F.lit("\n"), F.coalesce(sequence_col, F.lit("")))
    df.select(entry.alias("value")).write.mode("overwrite").text(target)


def widened(df: DataFrame, id_col: str, vector: str, dimension: int, prefix: str = "spectrum_encoding_") -> DataFrame:
    """id and one float column for each component of a vector."""
    return df.select(id_col, *[F.get(vector, i).cast("float").alias(f"{prefix}{i}") for i in range(dimension)])
