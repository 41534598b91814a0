"""Readers of spectra in every format, into one schema.

Files are read by Spark's own sources (Parquet, CSV, text, binary files), so any
path that Spark can open will do. MGF is split at its record ends like any text,
XML at its spectra and Arrow files at their record batches.
"""

from __future__ import annotations

import io
import itertools
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peakloom.constants import COLUMN_MAP, LEGACY_COLUMNS
from peakloom.functions.masses import precursor_mass
from peakloom.functions.tokens import accession, sanitise, scan_number
from peakloom.operators import schema
from peakloom.sources import footers, ipc, ranges, spectra_xml

RAW = "file string, ordinal long, label string, sequence string, precursor_mz double, precursor_charge long, retention_time double, mz_array array<double>, intensity_array array<double>"



def parse_mzml(content: bytes) -> Iterator[dict]:
    """The MS2 spectra of a whole mzML document."""
    ordinal = 0
    for _, node in ElementTree.iterparse(io.BytesIO(content)):
        if spectra_xml._tag(node) == "spectrum":
            if (row := spectra_xml.mzml_row(node, 2)) is not None:
                yield row | {"ordinal": ordinal}
                ordinal += 1
            node.clear()


def parse_mzxml(content: bytes) -> Iterator[dict]:
    """The MS2 scans of a whole mzXML document."""
    ordinal = 0
    for _, node in ElementTree.iterparse(io.BytesIO(content)):
        if spectra_xml._tag(node) == "scan":
            if (row := spectra_xml.mzxml_row(node, 2)) is not None:
                yield row | {"ordinal": ordinal}
                ordinal += 1
            if node.get("msLevel") != "1":
                node.clear()


def _from_documents(spark: SparkSession, path: str | list[str], parse: Callable[[bytes], Iterator[dict]]) -> DataFrame:
    """Whole documents, one a row, from stores that only Spark reads; each is bounded by 2 GB."""
    names = [f.split()[0] for f in RAW.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for found in itertools.batched(parse(content.as_py()), spectra_xml.SPECTRA):
                    found = [{"file": file} | r for r in found]
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], k) for n, k in zip(names, kinds, strict=True)], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, RAW)


def _from_xml(spark: SparkSession, path: str | list[str], source: type, parse: Callable, split: int | None) -> DataFrame:
    """MS2 spectra of XML files, each with its place in its file. Files of several ranges are counted first, so that places go through."""
    files = ranges.listed(spark, path)
    if any(ranges.scheme(uri) not in ranges.SCHEMES for uri, _ in files):
        return _from_documents(spark, path, parse)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
    split = split or ranges.SPLIT
    reader = spark.read.format(source.name()).option("files", ranges.packed(files)).option("split", split)
    rows = reader.load().where("ms_level = 2")
    names = [f.split()[0] for f in RAW.split(", ")]
    if all(size <= split for _, size in files):
        return rows.select(names)
    counts = reader.option("counts", "true").option("level", 2).load()  # a row for each range
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("file").alias("f"), F.col("block").alias("b"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = rows.join(F.broadcast(before), (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
    return placed.withColumn("ordinal", F.col("ordinal") + F.col("before")).select(names)


def read_mzml(spark: SparkSession, path: str | list[str], split: int | None = None, **options) -> DataFrame:
    return _finished(_from_xml(spark, path, spectra_xml.MzmlSource, parse_mzml, split), **options)


def read_mzxml(spark: SparkSession, path: str | list[str], split: int | None = None, **options) -> DataFrame:
    return _finished(_from_xml(spark, path, spectra_xml.MzxmlSource, parse_mzxml, split), **options)


def read_mgf(spark: SparkSession, path: str | list[str], scan_from: str = "ordinal", **options) -> DataFrame:
    """MGF records; the scan number is the record's place in its file, or its SCANS field if asked for."""
    records = spark.read.option("lineSep", "END IONS").text(path).where(F.contains("value", F.lit("BEGIN IONS")))
    text = records.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("n"), F.regexp_replace("value", "\r", "").alias("value"),
    )
    # A block's records lie behind one another in one task, so a record's place is its distance from the block's first and
    # the number of records in the file's earlier blocks: a row for each block is all that is gathered or sent.
    blocks = text.groupBy("file", "start").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("records"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("file").alias("f"), F.col("start").alias("s"), "first", F.coalesce(F.sum("records").over(earlier), F.lit(0)).alias("before"))
    text = text.join(F.broadcast(blocks), (F.col("file") == F.col("f")) & (F.col("start") == F.col("s")))
    field = lambda name: F.nullif(F.regexp_extract("value", rf"(?m)^{name}=(.*)$", 1), F.lit(""))
    number = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
    peaks = F.regexp_extract_all("value", F.lit(rf"(?m)^\s*{number}[ \t]+{number}"), F.lit(0))
    part = lambda i: F.transform(peaks, lambda p: F.get(F.split(F.trim(p), r"[ \t]+"), i).cast("double"))
    charge = F.regexp_extract(field("CHARGE"), r"(\d+)", 1).try_cast("bigint")
    sign = F.when(F.contains(field("CHARGE"), F.lit("-")), -1).otherwise(1)
    rows = text.select(
        "file", (F.col("before") + F.col("n") - F.col("first")).cast("bigint").alias("ordinal"),
        (field("SCANS") if scan_from == "scans" else F.lit(None).cast("string")).alias("label"), F.coalesce(field("SEQ"), F.lit("")).alias("sequence"),
        F.get(F.split(field("PEPMASS"), r"\s+"), 0).try_cast("double").alias("precursor_mz"), (charge * sign).alias("precursor_charge"),
        field("RTINSECONDS").try_cast("double").alias("retention_time"), part(0).alias("mz_array"), part(1).alias("intensity_array"),
    )
    return _finished(rows, **options)


def _finished(rows: DataFrame, add_source: bool = False) -> DataFrame:
    """Raw records in the common schema, with scan number, precursor mass, run name and spectrum id."""
    out = rows.withColumn("scan_number", scan_number(F.col("label"), F.col("ordinal")))
    out = out.withColumn("precursor_mass", precursor_mass(F.col("precursor_mz"), F.col("precursor_charge")))
    out = schema.identified(out, schema.file_stem(F.col("file")), F.col("ordinal"))
    out = out.withColumn("source_file", F.col("file")) if add_source else out
    return out.drop("file", "ordinal", "label")


def read_ipc(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """Arrow IPC files, by runs of record batches; the schema is that of the first file."""
    return _columnar(ipc.load(spark, path), **options)


def read_csv(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    return _columnar(spark.read.option("header", True).option("inferSchema", True).option("escape", '"').csv(path), **options)


def read_parquet(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """Parquet files, whose columns may differ, also in type: the first file that has a column tells its type."""
    paths = [path] if isinstance(path, str) else path
    files = _parquet_files(spark, paths)
    return _columnar(footers.unified(spark, files) if files else spark.read.option("mergeSchema", True).parquet(*paths), **options)


def _parquet_files(spark: SparkSession, paths: list[str]) -> list[tuple[str, int]]:
    """The files of paths, folders and globs; none where folders hold folders, or where only Spark reads the store."""
    try:
        files = ranges.listed(spark, paths)
    except ValueError:
        return []
    return files if all(ranges.scheme(uri) in ranges.SCHEMES for uri, _ in files) else []


def row_at(spark: SparkSession, path: str | list[str], index: int, **options) -> DataFrame:
    """One row of Parquet files by its index (from 0), in the order of the files, with its peptide as load_spectra gives it; only its file is read."""
    return _columnar(footers.row_at(spark, ranges.listed(spark, path), index), **options)


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """protein_id (the accession between bars, or else the header's first word), header and sequence of FASTA entries; files are split at entries."""
    entries = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value"))
    header = F.rtrim(F.substring_index("value", "\n", 1))
    body = F.when(F.contains("value", F.lit("\n")), F.regexp_replace(F.substring("value", F.instr("value", "\n") + 1, F.char_length("value")), r"\s", "")).otherwise("")
    rows = entries.select(header.alias("header"), body.alias("sequence")).where("header <> ''")
    name = F.get(F.split("header", r"\s"), 0)
    return rows.select(F.coalesce(accession(name), name).alias("protein_id"), "header", "sequence")


def read_predictions(
    spark: SparkSession, paths: str | list[str], key: str, prediction: str, confidence: str | None = None, also: tuple[str, ...] = ()
) -> DataFrame:
    """Earlier predictions of several CSV files, whose further columns and column orders may differ: key, prediction and the columns of `also` as text, confidence as a number.

    A file without one of the columns is an error that names the column and the file.
    """
    kinds = {key: "string", prediction: "string"} | ({confidence: "double"} if confidence else {}) | {c: "string" for c in also}
    out = None
    for path in [paths] if isinstance(paths, str) else paths:
        rows = spark.read.option("header", True).option("escape", '"').csv(path)
        for name in kinds:
            if name not in rows.columns:
                raise ValueError(f"Column '{name}' does not exist in {path}.")
        rows = rows.select(*[F.col(f"`{c}`").cast(kind).alias(c) for c, kind in kinds.items()])
        out = rows if out is None else schema.union_strict(out, rows)
    if out is None:
        raise ValueError("no readable input: no paths")
    return out


def _columnar(df: DataFrame, column_mapping: dict[str, str] | None = None, prefer_modified: bool = True) -> DataFrame:
    df = schema.renamed(df, COLUMN_MAP if column_mapping is None else column_mapping)
    df = schema.preferred_sequence(df) if prefer_modified else df
    df = df.withColumn("sequence", sanitise(F.col("sequence"))) if "sequence" in df.columns else df
    return schema.coerced(df)


def from_frame(spark: SparkSession, frame: object, **options) -> DataFrame:
    """A table that is in memory already (pandas, an Arrow table, or what has to_arrow or to_pandas, as polars and dataset libraries do) as spectra."""
    if isinstance(frame, pa.Table):
        table = frame
    elif hasattr(frame, "to_arrow"):
        table = frame.to_arrow()
    else:
        frame = frame.to_pandas() if hasattr(frame, "to_pandas") else frame
        table = pa.Table.from_pandas(frame, preserve_index=False)
    return _columnar(spark.createDataFrame(table), **options)


def migrate_legacy(spark: SparkSession, source: str | list[str], target: str) -> list[str]:
    """Arrow files with the old column names written anew under the present ones; the uris of the new files."""
    from peakloom.sources.sinks import write_ipc

    return write_ipc(from_legacy(ipc.load(spark, source)), target, "overwrite")


def from_legacy(df: DataFrame) -> DataFrame:
    """An old table's columns under their new names, the modified sequence without its underscores."""
    out = schema.renamed(df, LEGACY_COLUMNS)
    return out.withColumn("modified_sequence", F.btrim("modified_sequence", F.lit("_"))) if "modified_sequence" in out.columns else out


READERS: dict[str, Callable[..., DataFrame]] = {
    "ipc": read_ipc, "arrow": read_ipc, "feather": read_ipc, "mgf": read_mgf, "mzml": read_mzml, "mzxml": read_mzxml, "csv": read_csv, "parquet": read_parquet,
}


def file_begins(df: DataFrame, file: str) -> DataFrame:
    """Of each file, in the order of names: rows, and begin, the number of rows in the files before it."""
    counts = df.groupBy(file).agg(F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return counts.withColumn("begin", F.coalesce(F.sum("rows").over(before), F.lit(0)))


def load_spectra(
    spark: SparkSession, source: str | list[str], source_type: str | None = None, name: str | None = None, partition: str | None = None,
    annotated: bool = False, custom: Callable[[SparkSession, str], DataFrame] | None = None, preprocess: Callable[[DataFrame], DataFrame] | None = None, **options,
) -> DataFrame:
    """Spectra from a file, a glob, a list of them, or a folder of dataset-{name}-{partition}-*-*.parquet.

    custom reads each source in place of the readers; preprocess is applied to what was read, before columns are checked.
    """
    done = lambda df: schema.check_columns(df if preprocess is None else preprocess(df), annotated)
    if custom is not None:
        parts = [custom(spark, s) for s in ([source] if isinstance(source, str) else source)]
        out = parts[0]
        for part in parts[1:]:
            out = schema.union_relaxed(out, part)
        return done(out)
    if isinstance(source, str) and name is not None:
        source, source_type = f"{source.rstrip('/')}/dataset-{name}-{partition}-*-*.parquet", "parquet"
    sources = [source] if isinstance(source, str) else list(source)
    kinds: dict[str, list[str]] = {}
    for s in sources:
        kinds.setdefault((source_type or s.rsplit(".", 1)[-1]).lower(), []).append(s)
    out = None
    for kind, paths in kinds.items():
        if kind in READERS:
            part = READERS[kind](spark, paths, **options)
            out = part if out is None else schema.union_relaxed(out, part)
    if out is None:
        raise ValueError(f"no readable input: {source}")
    return done(out)
