"""What the footers of Parquet files tell: rows and schemas, read in tasks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.sources import ranges


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for files in batches:
        rows = []
        for place, uri in zip(files.column(0).to_pylist(), files.column(1).to_pylist(), strict=True):
            with ranges.opened(uri) as file:
                footer = pq.ParquetFile(file)
                kinds = ";".join(f"{f.name}:{f.type}" for f in footer.schema_arrow)
                rows.append((place, uri, footer.metadata.num_rows, kinds))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["place", "uri", "rows", "kinds"])


def footers(spark: SparkSession, files: list[tuple[str, int]]) -> DataFrame:
    """place, uri, rows and kinds (names and types of the columns) of each file of ranges.listed()."""
    rows = spark.createDataFrame([(i, uri) for i, (uri, _) in enumerate(files)], "place long, uri string")
    return rows.repartition(min(len(files), 200), "place").mapInArrow(_read, "place long, uri string, rows long, kinds string")


def unified(spark: SparkSession, files: list[tuple[str, int]]) -> DataFrame:
    """All rows of Parquet files whose schemas may differ: a column has the type of the first file that has it, in the order of the files.

    The files of one schema are read together; their columns are cast, and null where they have none. A value that does
    not fit the first type stops the job. A row for each file comes to the driver.
    """
    groups: dict[str, list[str]] = {}
    for r in footers(spark, files).orderBy("place").collect():
        groups.setdefault(r["kinds"], []).append(r["uri"])
    parts = [spark.read.parquet(*uris) for uris in groups.values()]
    first: dict = {}
    for part in parts:
        for f in part.schema:
            first.setdefault(f.name, f.dataType)

    def shaped(part: DataFrame) -> DataFrame:
        kinds = {f.name: f.dataType for f in part.schema}
        return part.select(*[(F.col(f"`{c}`") if kinds[c] == k else F.col(f"`{c}`").cast(k)).alias(c) if c in kinds else F.lit(None).cast(k).alias(c) for c, k in first.items()])

    return reduce(DataFrame.unionAll, map(shaped, parts))


def row_at(spark: SparkSession, files: list[tuple[str, int]], index: int) -> DataFrame:
    """The row with an index (from 0) in the files' order: the footers' counts tell its file, which alone is read."""
    before = 0
    for r in footers(spark, files).orderBy("place").select("uri", "rows").collect():  # a row for each file
        if before <= index < before + r["rows"]:
            return spark.read.parquet(r["uri"]).where(F.col("_metadata.row_index") == index - before)
        before += r["rows"]
    raise IndexError(f"row {index} of {before}")
