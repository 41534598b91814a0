"""Tables that end a lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables that written() has made and removed() has not deleted yet.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session, whose executors are this machine, may do without."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = f"file://{tempfile.gettempdir()}/peakloom-checkpoints"
    return where.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A name for a new folder in the shared one, which cleared() will delete."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    df.write.parquet(path := folder(spark, name))
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def removed(df: DataFrame) -> None:
    """Delete the files of a table that written() made and that no plan reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)
        _made[:] = [m for m in _made if not folder.endswith(m.rsplit("/", 1)[1])]


def made() -> int:
    """How many folders there are to clear: a mark for removed_since()."""
    return len(_made)


def removed_since(spark: SparkSession, mark: int, keep: DataFrame) -> None:
    """Delete the folders made since a mark, but for that of one table that does not depend on the others any more."""
    kept = {f.rsplit("/", 2)[-2] for f in keep.inputFiles()}
    for path in _made[mark:]:
        if path.rsplit("/", 1)[1] not in kept:
            _delete(spark, path)
            _made.remove(path)


def cleared(spark: SparkSession) -> int:
    """Delete all tables that written() has made in this session, once every result that reads them is stored; how many."""
    count = len(_made)
    while _made:
        _delete(spark, _made.pop())
    return count
