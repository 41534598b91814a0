"""WARC archives, written with Spark's text writer and read in byte ranges, whatever the payloads hold.

A record's end is told by the lengths in its header alone, and the mark that starts a
record may also stand inside a payload, so a task that starts in the middle of a file
cannot know which marks are real. Each task therefore emits candidates: every mark in
its range that a header follows, with the offset that its successor must have. Inside
a range chains of candidates are followed at once; what remains, a few links from
range to range, is followed from the start of each file by pointer jumping. Only what
the chain reaches is a record, and the marks it jumps over are payload.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peakloom.llm.shared import text_of
from peakloom.operators.joins import bounded_broadcast
from peakloom.storage import removed, written

# The format's marks and the digits of base 32.
MAGIC, LINE, PROFILE = "WARC/1.", "\r\n", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: What parts the pieces that tasks read; a header cannot hold it, as no line of a header starts with the mark.
BREAK = LINE + MAGIC
#: Copies of a digest's row where there are too many to broadcast.
SALTS = 16


def digest_of(payload: Column) -> Column:
    """Bare upper-case base-32 SHA-1. Ten hex digits are eight of base 32."""
    sha = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(sha, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


def _field(name: str, value: Column) -> Column:
    """A line of a header; nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(LINE)), F.lit(""))


def _record_id(key: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.url_encode(key.cast("string")), F.lit("")), F.lit(">"))


def key_of(record_id: Column) -> Column:
    """The key (a string) that a record id was made of."""
    return F.url_decode(F.nullif(F.regexp_extract(record_id, "^<urn:page:(.*)>$", 1), F.lit("")))


def write_archives(
    pages: DataFrame, target: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = 0, date: str = "1970-01-01T00:00:00Z"
) -> None:
    """A folder of WARC files with one record per row: `response` with the text in UTF-8 as payload, or `revisit` of an equal payload.

    Of rows with equal payloads (the same SHA-256) of at least `least` bytes that with the smallest id is the response;
    rows that repeat with this id all are. Smaller payloads are all responses. Null text is the empty payload; a null
    id comes after all others, so rows of one payload that all have null ids are all responses. A null url has no line;
    line ends in urls are percent-encoded. No rows make a folder without files of records; columns beside these three
    are not looked at. Files are Spark's part files: a task that fails or runs twice leaves none behind.
    """
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), text_of(F.col(f"`{text_col}`")).alias("text"))
    size = F.octet_length("text")
    rows = rows.withColumn("sha", F.when(size >= least, F.sha2(F.col("text").cast("binary"), 256)))
    groups = rows.where("sha is not null").groupBy("sha").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = written(groups.select(F.col("sha").alias("of"), "first"), "payload-copies")
    small = bounded_broadcast(groups)
    if small is groups:  # payloads are dealt by digest and id, so that one with many copies is spread
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
        small = groups.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.join(small, (F.col("sha") == F.col("of")) & (F.col("salt") == F.col("s")), "left")
    else:
        rows = rows.join(small, F.col("sha") == F.col("of"), "left")
    again = F.col("of").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    known = rows.withColumns({"again": again, "digest": digest_of(F.col("text").cast("binary")), "size": size})
    body = F.when(F.col("again"), "").otherwise(F.col("text"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    only = lambda value: F.when(F.col("again"), value)
    record = F.concat(
        F.lit(f"{MAGIC}1{LINE}"), _field("WARC-Type", F.when(F.col("again"), "revisit").otherwise("response")), _field("WARC-Record-ID", _record_id(F.col("id"))),
        _field("WARC-Target-URI", url), _field("WARC-Date", F.lit(date)), _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        _field("WARC-Refers-To", only(_record_id(F.col("first")))), _field("WARC-Profile", only(F.lit(PROFILE))),
        _field("X-Payload-Length", only(F.col("size").cast("string"))), _field("Content-Type", F.lit("text/html; charset=utf-8")),
        _field("Content-Length", F.octet_length(body).cast("string")), F.lit(LINE), body,
    )
    known.select(record.alias("value")).write.option("lineSep", LINE * 2).text(target)
    removed(groups)


def _pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, block (where a task's range of the file starts) and value: what lies between marks, in order within a block."""
    return spark.read.option("lineSep", BREAK).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, int]]:
    """file, block, first row and end of each run of rows of one block."""
    files, blocks = batch.column("file").dictionary_encode(), batch.column("block").to_numpy()
    codes = files.indices.to_numpy()
    edges = np.flatnonzero((np.diff(codes) != 0) | (np.diff(blocks) != 0)) + 1
    for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
        yield files.dictionary[codes[a]].as_py(), int(blocks[a]), int(a), int(b)


def _followed(file: str, block: int, places: np.ndarray, nexts: np.ndarray, first: int, total: int) -> pa.RecordBatch:
    """The candidates of one block, each with the offset at which its chain leaves the block (null if it breaks off there) and the last record before; and a row for the block.

    All offsets count from the start of the block's first piece.
    """
    at = np.searchsorted(places, nexts)
    inside = (at < len(places)) & (places[np.minimum(at, max(0, len(places) - 1))] == nexts) if len(places) else np.zeros(0, bool)
    to = np.where(inside, at, np.arange(len(places)))
    while (further := to[to]).tolist() != to.tolist():
        to = further
    leaves = nexts[to]
    lost = leaves < total - len(BREAK)  # it should be in this block but is not
    columns = [
        pa.array(np.append(places, first)), pa.array(np.append(leaves, 0), mask=np.append(lost, True)), pa.array(np.append(places[to], 0), mask=np.append(lost * False, True)),
        pa.array(np.append(np.zeros(len(places), np.int64), total), mask=np.append(np.ones(len(places), bool), False)),
    ]
    n = len(places) + 1
    return pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array([block] * n, pa.int64()), *columns], ["file", "block", "at", "leaves", "last", "total"])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_followed() for each block of a task; batches have file, block, size, head, length (of the content; null: no header) and marked (whether the mark is part of the piece)."""
    now, places, nexts, so_far, first = None, [], [], 0, 0
    for batch in batches:
        size, head, marked = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("size", "head", "marked"))
        length = batch.column("length").fill_null(-1).to_numpy().astype(np.int64)
        for file, block, a, b in _runs(batch):
            if now != (file, block):
                if now is not None:
                    yield _followed(*now, np.concatenate(places), np.concatenate(nexts), first, so_far)
                now, places, nexts, so_far, first = (file, block), [], [], 0, 0 if block == 0 else -len(MAGIC)
            ends = so_far + np.cumsum(size[a:b] + len(BREAK))
            begins = ends - size[a:b] - len(BREAK)
            opening = (begins == 0) & (block == 0)  # the file's first piece has the mark in it; others come after theirs
            mark = begins - np.where(opening, 0, len(MAGIC))
            good = (length[a:b] >= 0) & ((marked[a:b] > 0) == opening)
            places.append(mark[good])
            nexts.append((begins + head[a:b] + 2 * len(LINE) + length[a:b] + 2 * len(LINE))[good])
            so_far = int(ends[-1])
    if now is not None:
        yield _followed(*now, np.concatenate(places), np.concatenate(nexts), first, so_far)


def _index(pieces: DataFrame) -> DataFrame:
    # Where a payload starts with a mark, the second of a header's last two line ends went to the break.
    head = F.substring_index(F.concat("value", F.lit(LINE)), LINE * 2, 1)
    found = pieces.withColumns({"size": F.octet_length("value"), "head": F.octet_length(head)})
    text = F.when((F.col("head") < F.col("size")) & F.col("value").rlike(r"\A(WARC/1\.)?[0-9]\r\n"), head)
    length = F.nullif(F.regexp_extract(text, r"(?im)^content-length:[ \t]*([0-9]{1,18})[ \t]*\r?$", 1), F.lit("")).cast("long")
    return found.select("file", "block", "size", "head", length.alias("length"), F.startswith("value", F.lit(MAGIC)).alias("marked")).mapInArrow(
        _candidates, "file string, block long, at long, leaves long, last long, total long"
    )


def _chained(links: DataFrame) -> DataFrame:
    """file, at of the links that the link at the start of their file leads to, itself included. links: file, at, leaves.

    Pointer jumping: what is reached doubles each round, and so does how far a pointer jumps, so rounds are as many as
    the logarithm of the longest chain of links.
    """
    to = links.select("file", F.col("at").alias("leaves"))
    jumps = written(links.join(to, ["file", "leaves"], "left_semi").select("file", "at", F.col("leaves").alias("to")), "jumps")
    reached = written(links.where("at = 0").select("file", "at"), "reached")
    count, before = reached.count(), -1
    while count > before:
        step = reached.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at"))
        wider = written(reached.union(step).distinct(), "reached")
        far = jumps.join(jumps.select("file", F.col("at").alias("to"), F.col("to").alias("beyond")), ["file", "to"]).select("file", "at", F.col("beyond").alias("to"))
        farther = written(far, "jumps")
        before, count = count, wider.count()
        removed(reached), removed(jumps)
        reached, jumps = wider, farther
    return reached


def boundaries(spark: SparkSession, path: str | list[str], strict: bool = True) -> DataFrame:
    """A row for each block of the files: file, block, base, entry, owner, until, orphans.

    base is the offset of the block's first piece, entry that of the first record that starts in the block (null:
    none), owner that of the last one before it, which ends at until, and orphans tells that pieces of the block belong
    to that one. With strict, a file whose chain of records does not end where the file ends is an error.
    """
    index = written(_index(_pieces(spark, path)), "warc-index")
    by_file = Window.partitionBy("file").orderBy("block")  # a row for each block
    blocks = index.where("total is not null").select("file", "block", F.col("at").alias("first"), "total")
    blocks = blocks.withColumn("base", F.coalesce(F.sum("total").over(by_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    blocks = written(blocks, "warc-blocks")
    found = index.where("total is null").drop("total").join(bounded_broadcast(blocks.select("file", "block", "base")), ["file", "block"])
    found = found.select("file", "block", *[(F.col(c) + F.col("base")).alias(c) for c in ("at", "leaves", "last")])
    targets = found.select("file", F.col("leaves").alias("at")).where("at is not null").distinct()
    starts = blocks.select("file", F.lit(0).cast("long").alias("at")).distinct()
    links = written(found.join(targets.union(starts), ["file", "at"], "left_semi"), "warc-links")
    real = _chained(links)
    chain = links.join(real, ["file", "at"], "left_semi").select("file", "block", F.col("at").alias("entry"), "leaves", "last")
    if strict:
        ends = blocks.groupBy("file").agg((F.sum("total") - len(BREAK)).alias("end"))
        broken = ends.join(chain.groupBy("file").agg(F.max("leaves").alias("leaves")), "file", "left").where("not (leaves <=> end)")
        if (bad := broken.agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("file")).first())["n"]:
            raise ValueError(f"{bad['n']} archives break off or have damaged records, such as {bad['file']}")
    earlier = by_file.rowsBetween(Window.unboundedPreceding, -1)
    out = blocks.join(chain, ["file", "block"], "left").select(
        "file", "block", "base", "entry", F.last("last", True).over(earlier).alias("owner"), F.last("leaves", True).over(earlier).alias("until"),
        (F.col("entry").isNull() | (F.col("first") + F.col("base") < F.col("entry"))).alias("orphans"),
    )
    out = written(out.withColumn("orphans", F.col("orphans") & F.col("owner").isNotNull()), "warc-boundaries")
    for done in (index, blocks, links, real):
        removed(done)
    return out


_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*([0-9]{1,18})[ \t]*\r?$")


def _sizes(raw: bytes) -> tuple[int, int]:
    """Bytes of a record's header, its empty line included, and of its content; raw may end before the empty line."""
    head = raw.find(b"\r\n\r\n")
    head = len(raw) - 2 if head < 0 else head
    return head + 4, int(_LENGTH.search(raw, 0, head + 2)[1])


def _records(cut: bool):
    """Records that lie in one block (file, offset, head, content); with cut, the pieces of the others (file, offset, at, raw) instead."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begin, expected, record = None, 0, None, None  # record: offset, bytes needed, [(at, raw)]
        out: list[tuple] = []

        def ended() -> None:
            offset, (head, content), parts = record
            if sum(len(raw) for _, raw in parts) >= head + content:
                if not cut:
                    raw = parts[0][1] if len(parts) == 1 else b"".join(raw for _, raw in parts)
                    out.append((now[0], offset, raw[:head], raw[head : head + content]))
            elif cut:
                out.extend((now[0], offset, at, raw) for at, raw in parts)

        def batch_of() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int64() if cut else pa.binary(), pa.binary()]
            done = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["file", "offset", "at" if cut else "head", "raw" if cut else "content"])
            out.clear()
            return done

        for batch in batches:
            for file, block, a, b in _runs(batch):
                base, entry, owner, until = (batch.column(c)[a].as_py() for c in ("base", "entry", "owner", "until"))
                if now != (file, block):
                    if record is not None:
                        ended()
                    now, begin, expected, record = (file, block), base, entry, None
                for value in batch.column("value").slice(a, b - a):
                    value = value.as_py()
                    opening = begin == 0
                    mark = begin - (0 if opening else len(MAGIC))
                    if mark == expected:
                        if record is not None:
                            ended()
                        raw = value if opening else MAGIC.encode() + value
                        record = (mark, _sizes(raw), [(mark, raw)])
                        expected = mark + sum(record[1]) + 2 * len(LINE)
                    elif record is not None:
                        record[2].append((mark, BREAK.encode() + value))
                    elif cut and owner is not None and until is not None and mark < until:
                        out.append((file, owner, mark, BREAK.encode() + value))
                    begin += len(value) + len(BREAK)
            if out:
                yield batch_of()
        if record is not None:
            ended()
        if out:
            yield batch_of()

    return rows


def _joined(pieces: pd.DataFrame) -> pd.DataFrame:
    raw = b"".join(pieces.sort_values("at")["raw"])
    head, content = _sizes(raw)
    found = pd.DataFrame({"file": [pieces["file"].iloc[0]], "offset": [pieces["offset"].iloc[0]], "head": [raw[:head]], "content": [raw[head : head + content]]})
    return found if len(raw) >= head + content else found[:0]  # a file that breaks off has no more of it


def read_archives(spark: SparkSession, path: str | list[str], strict: bool = True) -> DataFrame:
    """Per record: file, offset, type, id, uri, refers_to, digest, payload_length (of the whole payload), content (bytes).

    Files are read in byte ranges, so one file may be read by many tasks; compressed ones are read by one. Fields that a
    header lacks are null. Records come from chains of verified boundaries only; a record whose payload holds marks and
    that goes on in the next range is put together from its pieces. With strict, a file that breaks off is an error;
    without it, its whole records up to the break are read. Empty files have no records.
    """
    plan = boundaries(spark, path, strict)
    keyed = _pieces(spark, path).withColumn("value", F.col("value").cast("binary"))
    # A row for each range of a file, a small part of the bytes that it stands for.
    placed = keyed.join(F.broadcast(plan.drop("orphans")), ["file", "block"]).select("file", "block", "value", "base", "entry", "owner", "until")
    records = placed.mapInArrow(_records(False), "file string, offset long, head binary, content binary")
    if not plan.where("orphans").isEmpty():
        files = F.broadcast(plan.where("orphans").select("file").distinct())
        parts = placed.join(files, "file", "left_semi").mapInArrow(_records(True), "file string, offset long, at long, raw binary")
        records = records.unionByName(parts.groupBy("file", "offset").applyInPandas(_joined, "file string, offset long, head binary, content binary"))
    head = F.decode("head", "ISO-8859-1")
    field = lambda name: F.nullif(F.regexp_extract(head, rf"(?im)^{name}:[ \t]*(.*?)[ \t]*\r?$", 1), F.lit(""))
    return records.select(
        "file", "offset", field("WARC-Type").alias("type"), field("WARC-Record-ID").alias("id"),
        F.decode(F.encode(field("WARC-Target-URI"), "ISO-8859-1"), "UTF-8").alias("uri"), field("WARC-Refers-To").alias("refers_to"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("digest"),
        F.coalesce(field("X-Payload-Length").cast("long"), F.octet_length("content").cast("long")).alias("payload_length"), "content",
    )


def inventory(records: DataFrame) -> DataFrame:
    """Per record: key, payload_bytes, payload_digest, record_type, refers_to. A response's bytes and digest are those of the content that was read; a revisit's those of its header."""
    revisit = F.col("type") == "revisit"
    return records.select(
        key_of(F.col("id")).alias("key"), F.when(revisit, F.col("payload_length")).otherwise(F.octet_length("content").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.col("digest")).otherwise(digest_of(F.col("content"))).alias("payload_digest"), F.col("type").alias("record_type"),
        F.when(revisit, key_of(F.col("refers_to"))).alias("refers_to"),
    )
