"""Small column helpers of the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that parts words: space and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task hands to Python at once where they hold whole texts.
TEXT_ROWS = 1000
_ROWS_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_rows(docs: DataFrame) -> DataFrame:
    """docs, with the session's Arrow batches cut to TEXT_ROWS rows if they are larger: both a task's JVM and its Python hold one at least."""
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get(_ROWS_CONF)) <= TEXT_ROWS:
        conf.set(_ROWS_CONF, str(TEXT_ROWS))
    return docs


def text_of(text: Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(text.cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the maximal runs outside the word-parting white space."""
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")


def bucket_of(key: Column, modulus: int) -> Column:
    """crc32 of the key written as text, modulo modulus."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(modulus))


def id_key(key: Column) -> Column:
    """A column that is never null and differs where ids do, a null id from every other included."""
    return F.coalesce(F.concat(F.lit("i"), key.cast("string")), F.lit("n"))


def content_of(text: Column) -> Column:
    """A text as an integer of 60 bits, the same in every engine that has MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def as_rows(docs: DataFrame, **keys: Column) -> DataFrame:
    """docs as one struct a row, __row, beside the keys: whatever names docs has, dots included, none can clash."""
    return docs.select(*[v.alias(k) for k, v in keys.items()], F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))


def from_rows(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of docs out of as_rows(), some of them changed."""
    return rows.select(*[changed[c].alias(c) if c in changed else F.col("__row").getField(c).alias(c) for c in docs.columns])


def one_row_each(docs: DataFrame, keys: dict[str, Column], winners: DataFrame) -> DataFrame:
    """Of the rows of docs whose keys (never null) are in winners one for each; columns and values as they were.

    Which of several rows with the same keys stays depends on their values alone. They meet in their tasks first, so
    a row repeated many times costs no task more than another.
    """
    rows = docs.select(*[v.alias(k) for k, v in keys.items()], F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__row"))
    rows = rows.groupBy(*keys).agg(F.max_by("__row", F.xxhash64("__row")).alias("__row"))
    return rows.join(winners, list(keys), "left_semi").select("__row.*")
