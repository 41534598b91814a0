"""Token totals by source, language and tokenizer version, kept up to date by signed changes.

The ledger is a folder. A batch holds additive sums per (source, lang, version): an
insert adds a document and its tokens, a delete takes them away, a revision takes
the old count away and adds the new one. Totals are the sum over batches, so a batch
never rereads what came before it.

A batch's sums are written to a folder of their own first. What commits it is one
small file, named after the batch, that names that folder; totals read only folders
that such a file names. The file is put in place whole by one rename of a file, so a
batch id has one file whichever of several writers comes first or last, and a run
that dies half-way leaves nothing behind that counts. compact() sums committed
batches into one folder and remembers their ids in its file.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.llm.bpe import chunks_of, encoder
from peakloom.storage import shared_dir

KEYS = ("source", "lang", "version")


def counted(docs: DataFrame, vocabularies: Mapping[str, str], text_col: str = "text", keep: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """Per row: the columns of keep, and the tokens of its whole text under each vocabulary (version name -> file), by the byte-level BPE encoder."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = [encoder(path) for path in vocabularies.values()]
        for batch in batches:
            for i, j, data, offsets in chunks_of(batch.column(len(keep))):
                sizes = [pa.array(np.diff(enc.encode(data, offsets)[1])) for enc in encoders]
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[: len(keep)]), *sizes], [*keep, *vocabularies])

    schema = ", ".join([f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep] + [f"`{v}` long" for v in vocabularies])
    return docs.select(*keep, docs[text_col].cast("string").alias("__text")).mapInArrow(rows, schema)


def inserts(counts: DataFrame) -> DataFrame:
    """Changes that add every row of counts (source, lang, version, tokens)."""
    return counts.select(*KEYS, F.lit(1).cast("long").alias("d_docs"), F.coalesce("tokens", F.lit(0)).cast("long").alias("d_tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    """Changes that take every row of counts away; counts are those the ledger was given."""
    return inserts(counts).withColumns({"d_docs": -F.col("d_docs"), "d_tokens": -F.col("d_tokens")})


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes that replace the rows of old by those of new."""
    return deletes(old).unionByName(inserts(new))


class TokenLedger:
    """Totals in a folder that all executors share.

    Null source, lang or version are keys of their own; a null count is 0. An
    empty batch commits and changes nothing. Repeated rows count as often as
    they come. Further columns are not looked at. Batch ids are any texts.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/token-ledger-{uuid.uuid4().hex}"
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def _marker(self, batch_id: str) -> str:
        return f"batches/{hashlib.sha256(batch_id.encode()).hexdigest()}"

    def _read(self, name: str) -> dict | None:
        """What a marker file says; None without one."""
        if not self._fs.exists(self._at(name)):
            return None
        stream = self._fs.open(self._at(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, name: str, said: dict) -> bool:
        """Put a marker file in place whole; whether it is this one that is there afterwards."""
        aside = f"aside/{uuid.uuid4().hex}"
        stream = self._fs.create(self._at(aside), False)
        try:
            stream.write(bytearray(json.dumps(said).encode()))
        finally:
            stream.close()
        self._fs.mkdirs(self._at(name).getParent())
        if self._fs.exists(self._at(name)) or not self._fs.rename(self._at(aside), self._at(name)):
            self._fs.delete(self._at(aside), False)
        return self._read(name) == said

    def _listed(self, folder: str) -> list[str]:
        if not self._fs.exists(self._at(folder)):
            return []
        return sorted(f"{folder}/{s.getPath().getName()}" for s in self._fs.listStatus(self._at(folder)))

    def _state(self) -> tuple[list[str], set[str], int]:
        """Folders that count, the markers of the batches in them, and the number of the last compaction (0: none)."""
        last = self._listed("compactions")[-1:]
        said = self._read(last[0]) if last else None
        folders, covered = ([said["folder"]], set(said["batches"])) if said else ([], set())
        fresh = [m for m in self._listed("batches") if m not in covered]
        folders += [self._read(m)["folder"] for m in fresh]
        return folders, covered | set(fresh), int(last[0].rsplit("/", 1)[1]) if last else 0

    def committed(self, batch_id: str) -> bool:
        return self._marker(batch_id) in self._state()[1]

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Commit a batch of changes; False if the batch is there already, which leaves the totals as they are."""
        if self.committed(batch_id):
            return False
        folder = f"sums/{uuid.uuid4().hex}"
        sums = changes.groupBy(*KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))
        sums.write.parquet(f"{self.path}/{folder}")
        return self._put(self._marker(batch_id), {"batch": batch_id, "folder": folder})

    def compact(self) -> bool:
        """Sum what is committed into one folder; False if another writer's compaction came first, whose result stands.

        The old folders and markers stay, for readers that have begun; vacuum() takes them away.
        """
        folders, batches, number = self._state()
        folder = f"sums/{uuid.uuid4().hex}"
        self._sums(folders).write.parquet(f"{self.path}/{folder}")
        return self._put(f"compactions/{number + 1:012d}", {"folder": folder, "batches": sorted(batches)})

    def vacuum(self) -> None:
        """Delete what no reader needs that begins now: compacted batches, and sums that no marker names. No writer may be at work."""
        folders, _, _ = self._state()
        last = self._listed("compactions")[-1:]
        covered = set(self._read(last[0])["batches"]) if last else set()
        for name in [*(s for s in self._listed("sums") if s not in folders), *(m for m in self._listed("batches") if m in covered), *self._listed("aside")]:
            self._fs.delete(self._at(name), True)

    def _sums(self, folders: list[str]) -> DataFrame:
        schema = "source string, lang string, version string, d_docs long, d_tokens long"
        paths = [f"{self.path}/{f}" for f in folders]
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return rows.groupBy(*KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens of the keys that have a document or a token."""
        sums = self._sums(self._state()[0])
        return sums.select(*KEYS, F.col("d_docs").alias("n_docs"), F.col("d_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")

    def rollup(self) -> DataFrame:
        """totals() at four levels: level, source, lang, version, n_docs, n_tokens; a key that a level sums over is null."""
        levels = {"source_lang": ("source", "lang"), "source": ("source",), "lang": ("lang",), "all": ()}
        base, out = self.totals(), None
        for level, keys in levels.items():
            part = base.groupBy(*keys, "version").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
            part = part.select(
                F.lit(level).alias("level"),
                *[F.col(k) if k in keys else F.lit(None).cast("string").alias(k) for k in ("source", "lang")],
                "version", "n_docs", "n_tokens",
            )
            out = part if out is None else out.unionByName(part)
        return out
