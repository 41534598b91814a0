"""Files as lists of byte ranges, read by tasks through Arrow's file systems."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyarrow import NativeFile, fs
from pyspark.sql import SparkSession

#: Schemes of files that tasks can open at any offset.
SCHEMES = {"file", "hdfs", "s3", "s3a", "gs", "abfs", "abfss"}
#: Bytes of a file that a task reads, unless asked otherwise.
SPLIT = 64 << 20


def listed(spark: SparkSession, path: str | list[str]) -> list[tuple[str, int]]:
    """(uri, bytes) of the files of paths, folders and globs, as Spark lists them: hidden ones are left out. An error where a path has none.

    Names and sizes alone pass the driver.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out: list[tuple[str, int]] = []
    for p in [path] if isinstance(path, str) else path:
        at = jvm.org.apache.hadoop.fs.Path(p)
        system = at.getFileSystem(conf)
        found = []
        for top in system.globStatus(at) or []:
            for s in system.listStatus(top.getPath()) if top.isDirectory() else [top]:
                if not s.isDirectory() and (not top.isDirectory() or s.getPath().getName()[0] not in "._"):
                    found.append((s.getPath().toString(), s.getLen()))
        if not found:
            raise ValueError(f"no readable input: {p}")
        out += sorted(found)
    return out


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme that Spark would look it up under."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


def scheme(uri: str) -> str:
    return uri.split(":", 1)[0]


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a uri and the path in it; file:/x and file:///x are one."""
    kind, rest = uri.split(":", 1)
    if kind == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"s3:{rest}" if kind == "s3a" else uri)


def opened(uri: str) -> NativeFile:
    system, path = located(uri)
    return system.open_input_file(path)


def packed(files: list[tuple[str, int]]) -> str:
    """Files as an option's text."""
    return json.dumps(files)


def ranges(files: str, split: int) -> Iterator[tuple[str, int, int]]:
    """uri, start and end of each range of the files of packed()."""
    for uri, size in json.loads(files):
        for start in range(0, size, split):
            yield uri, start, min(size, start + split)
