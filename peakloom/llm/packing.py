"""Packing of documents into sequences of fixed length.

Documents are tokenized and cut into pieces where they are read; the pieces'
sizes are written, and only they are shuffled. A full piece is a sequence by
itself. The others are dealt into groups of some thousands, so that a group is a
bounded task at any scale and costs at most the rest of one sequence. Within a
group best fit decreasing makes a first packing, and a local search then exchanges
pieces between underfull sequences so that the sum of squared fills rises, until
sequences run empty and no exchange is left that gains.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.llm.bpe import chunks_of, encoder
from peakloom.llm.shared import text_rows
from peakloom.storage import written


def token_pieces(
    docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32.

    A document's ids are those of its text and then end_id; null and empty texts have end_id alone. Only documents
    longer than size are cut: into pieces of size ids, of which the first may be shorter.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for i, j, data, offsets in chunks_of(batch.column(1)):
                ids, upto = enc.encode(data, offsets)
                ids = np.insert(ids, upto[1:], end_id).astype("<u4")
                upto = upto + np.arange(len(upto))
                total = np.diff(upto)
                count = -(-total // size)
                doc = np.repeat(np.arange(j - i), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                first = (total - (count - 1) * size)[doc]
                start = np.where(piece == 0, 0, first + (piece - 1) * size)
                length = np.where(piece == 0, first, size)
                at = upto[:-1][doc] + start
                crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    [id_col, "piece", "start", "length", "ids_crc32"],
                )

    schema = f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long"
    return text_rows(docs).select(id_col, docs[text_col].cast("string").alias("__text")).mapInArrow(rows, schema)


def best_fit(lengths: np.ndarray, size: int) -> np.ndarray:
    """Bin of each length by best fit decreasing. The free sizes that some bin has are the bits of one integer."""
    bins = np.empty(len(lengths), np.int64)
    with_free: list[list[int]] = [[] for _ in range(size + 1)]
    mask = count = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            b = with_free[free].pop()
            if not with_free[free]:
                mask &= ~(1 << free)
        else:
            b, free, count = count, size, count + 1
        bins[i] = b
        if free > n:
            with_free[free - n].append(b)
            mask |= 1 << (free - n)
    return bins


def local_search(lengths: np.ndarray, bins: np.ndarray, size: int) -> np.ndarray:
    """Bins after exchanges that raise the sum of squared fills.

    The emptiest bin gives first. One or two of its pieces go to another underfull bin, against one of that bin's
    pieces or against none, and the exchange of largest gain is made, while there is one. A bin that has run empty
    is gone. It ends when there are as few bins as all lengths together need, when the free room of the other bins
    is less than the emptiest one's fill, which no exchange could then place, or when no exchange gains. Every
    exchange raises a sum of whole numbers that is bounded, so one of these comes.
    """
    bins = bins.copy()
    fill = np.bincount(bins, lengths).astype(np.int64)
    least = -(-int(fill.sum()) // size)
    open_ = np.flatnonzero(fill < size)
    item = np.flatnonzero(fill[bins] < size)
    gained = True
    while gained:
        gained = False
        for a in open_[np.argsort(fill[open_], kind="stable")].tolist():
            if not 0 < fill[a] < size:
                continue
            live = open_[fill[open_] > 0]
            if (size - fill[live]).sum() - (size - fill[a]) < fill[live].min() or np.count_nonzero(fill) <= least:
                return bins
            while fill[a]:
                found = _best(lengths, bins, fill, item, live, a, size)
                if found is None:
                    break
                give, take, to = found
                d = int(lengths[give].sum()) - (int(lengths[take]) if take is not None else 0)
                bins[give] = to
                if take is not None:
                    bins[take] = a
                fill[a] -= d
                fill[to] += d
                gained = True
    return bins


def _best(lengths, bins, fill, item, live, a, size):
    """The exchange of bin a with the largest gain: pieces to give, piece to take or None, other bin."""
    own = item[bins[item] == a]
    offers = [(int(lengths[i]), [i]) for i in own.tolist()]
    seen = {}
    for k, i in enumerate(own.tolist()):
        for j in own[k + 1 :].tolist():
            seen.setdefault(int(lengths[i] + lengths[j]), [i, j])
    offers += list(seen.items())
    other = live[(live != a) & (fill[live] < size)]
    if not len(other):
        return None
    room = size - fill[other]
    theirs = item[(bins[item] != a) & (fill[bins[item]] < size)]
    their_bin, their_len = bins[theirs], lengths[theirs]
    best, gain = None, 0
    for n, give in offers:
        fits = room >= n
        if fits.any():
            k = int(np.argmax(np.where(fits, fill[other], -1)))
            if (g := n * (n + int(fill[other[k]]) - int(fill[a]))) > gain:
                best, gain = (give, None, int(other[k])), g
        d = n - their_len
        g = np.where((d > 0) & (d <= size - fill[their_bin]), d * (d + fill[their_bin] - fill[a]), 0)
        if len(g) and g[k := int(np.argmax(g))] > gain:
            best, gain = (give, int(theirs[k]), int(their_bin[k])), int(g[k])
    return best


def pack_lengths(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset within it of each length below size; bins are numbered from 0 without gaps."""
    bins = local_search(lengths, best_fit(lengths, size), size) if len(lengths) else np.zeros(0, np.int64)
    _, bins = np.unique(bins, return_inverse=True)
    order = np.argsort(bins, kind="stable")
    ends = np.cumsum(lengths[order])
    first = np.append(True, np.diff(bins[order]) > 0) if len(order) else np.zeros(0, bool)
    base = np.maximum.accumulate(np.where(first, ends - lengths[order], 0)) if len(order) else ends
    offsets = np.empty(len(lengths), np.int64)
    offsets[order] = ends - lengths[order] - base
    return bins, offsets


def pack(pieces: DataFrame, size: int = 2048, group_rows: int = 8192) -> DataFrame:
    """pieces with sequence_id and offset; pieces must be a table, as it is read more than once.

    A full piece has a sequence of its own with a negative id, made where the piece is read. The others are dealt to
    groups by their values and their place in the table, so that rows which repeat, with null ids or not, spread like
    any others; a group's number stands in the upper 32 bits of its sequences' ids. An empty table gives an empty
    result.
    """
    part = pieces.where(F.col("length") < size)
    groups = max(1, -(-part.count() // group_rows))

    def packed(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "ids_crc32", "start"], kind="stable", ignore_index=True)
        bins, offsets = pack_lengths(frame["length"].to_numpy(), size)
        return frame.drop(columns="group").assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)

    dealt = part.withColumn("group", F.pmod(F.xxhash64(*part.columns, F.monotonically_increasing_id()), F.lit(groups)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    full = pieces.where(F.col("length") >= size).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return dealt.groupBy("group").applyInPandas(packed, schema).unionByName(full)


def pack_documents(docs: DataFrame, vocabulary: str, size: int = 2048, **options) -> DataFrame:
    """Tokenize, cut and pack every row of docs; see token_pieces and pack."""
    return pack(written(token_pieces(docs, vocabulary, size, **options), "pieces"), size)
