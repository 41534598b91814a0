"""Which short strings occur in which long ones: peptides in a proteome, for one.

Up to a bounded size the different strings go to every task, which finds those that begin
at each place of its texts by their first bytes and compares them in full; texts stay
where they are. Beyond it, every window of the long strings is a row of an index. A short
string is looked up by its rarest window alone, an equality join, and each place found is
compared in full. A string with a window that the index lacks occurs nowhere and is not
looked up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.functions.tokens import remove_modifications
from peakloom.operators import joins
from peakloom.operators.joins import bounded_broadcast, spread_join
from peakloom.storage import removed, written

#: Rows of a seed above which its rows are dealt to several tasks, and to how many.
HOT, SALTS = 50_000, 32
#: Windows that a task passes on at once.
ROWS = 50_000
#: Places of texts that are searched at once, and pairs of a place and a string that are compared at once.
CHUNK, PAIRS = 1 << 20, 1 << 20


class Finder:
    """Where strings begin in bytes: by a string's first 1, 2, 4 or 8 bytes as a number, then by all of it."""

    def __init__(self, strings: list[str]) -> None:
        raw = [s.encode() for s in strings]
        self.sizes = np.array([len(r) for r in raw], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(raw) + bytes(8), np.uint8)
        self.kinds = []
        for w in (1, 2, 4, 8):
            own = np.flatnonzero((self.sizes >= w) & ((self.sizes < 2 * w) | (w == 8)))
            if len(own):
                heads = self.numbers(self.flat, w)[self.starts[own]]
                own = own[np.argsort(heads, kind="stable")]
                keys, first, count = np.unique(np.sort(heads), return_index=True, return_counts=True)
                bits = min(8 * w, max(16, int(8 * len(keys)).bit_length()))
                some = np.zeros(1 << bits, bool)
                some[self._slot(keys, bits)] = True
                self.kinds.append((w, own, keys, first, count, bits, some))

    @staticmethod
    def numbers(data: np.ndarray, w: int) -> np.ndarray:
        """A view of the w bytes from each place on as a number; data has 8 bytes behind its last place."""
        return np.ndarray((len(data) - 8,), f"<u{w}", data, strides=(1,))

    @staticmethod
    def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
        width = 8 * keys.dtype.itemsize
        return keys if width == bits else (keys * keys.dtype.type(0x9E3779B97F4A7C15 & ((1 << width) - 1))) >> keys.dtype.type(width - bits)

    def found(self, data: np.ndarray, ends: np.ndarray, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(strings, places), some at once, of the strings that begin in [lo, hi) of data and end by ends, one for each place there."""
        for w, own, keys, first, count, bits, some in self.kinds:
            heads = self.numbers(data, w)[lo:hi].copy()
            at = np.flatnonzero(some[self._slot(heads, bits)])
            k = np.minimum(np.searchsorted(keys, heads[at]), len(keys) - 1)
            same = keys[k] == heads[at]
            at, k = at[same], k[same]
            upto = np.cumsum(count[k])
            text, pattern = self.numbers(data, w), self.numbers(self.flat, w)
            begin = 0
            while begin < len(at):
                before = upto[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(upto, before + PAIRS, "right")))
                n = count[k[begin:end]]
                place = np.repeat(at[begin:end], n)
                which = own[np.repeat(first[k[begin:end]], n) + np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)]
                keep = lo + place + self.sizes[which] <= ends[place]
                place, which, step = lo + place[keep], which[keep], w
                late = np.flatnonzero(self.sizes[which] > step)
                gone = np.zeros(len(which), bool)
                while len(late):  # the last bytes overlap with those before
                    offset = np.minimum(step, self.sizes[which[late]] - w)
                    equal = text[place[late] + offset] == pattern[self.starts[which[late]] + offset]
                    gone[late[~equal]] = True
                    step += w
                    late = late[equal & (self.sizes[which[late]] > step)]
                yield which[~gone], place[~gone]
                begin = end


def _firsts(which: np.ndarray, text: np.ndarray, place: np.ndarray, strings: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row for each string and text, with the first place; places ascend."""
    low = int(text.min()) if len(text) else 0
    texts = int(text.max()) - low + 1 if len(text) else 0
    key = which * texts + (text - low)
    if strings * texts <= 4 * CHUNK:
        first = np.full(strings * texts, -1)
        first[key[::-1]] = np.arange(len(key))[::-1]
        at = first[first >= 0]
    else:
        at = np.unique(key, return_index=True)[1]
    return which[at], text[at], place[at]


def _places(strings: Broadcast, first: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """string, id and place of the strings in each text; of a string's places in a text the first alone, if asked for."""
        names, finder = pa.array(strings.value, pa.string()), Finder(strings.value)
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string())
            bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
            data, bounds = np.append(raw, np.zeros(8, np.uint8)), bounds - bounds[0]

            def put(which: np.ndarray, text: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([names.take(pa.array(which)), batch.column(0).take(pa.array(text)), pa.array(place)], ["string", "id", "place"])  # noqa: B023

            ahead, rank = np.zeros(len(texts), np.int64), 0  # characters before each text, and before a chunk
            cut, seen = -1, np.zeros(0, np.int64)  # the text that a chunk breaks off in, and its strings so far
            for lo in range(0, len(raw), CHUNK):
                hi = min(lo + CHUNK, len(raw))
                begin, end = np.searchsorted(bounds, lo, "right") - 1, np.searchsorted(bounds, hi, "left")
                text = np.repeat(np.arange(begin, end), np.diff(np.clip(bounds[begin : end + 1], lo, hi)))
                chars = rank + np.cumsum((data[lo:hi] & 0xC0) != 0x80)
                here = begin + np.flatnonzero((bounds[begin:end] >= lo) & (bounds[begin:end] < hi))
                ahead[here], rank = chars[bounds[here] - lo], int(chars[-1])
                held = []
                for which, at in finder.found(data, bounds[text + 1], lo, hi):
                    owner = text[at - lo]
                    part = which, owner, chars[at - lo] - ahead[owner]
                    if first:
                        held.append(_firsts(*part, len(names)))
                    elif len(which):
                        yield put(*part)
                if held:
                    parts = [np.concatenate(p) for p in zip(*held, strict=True)]
                    order = np.argsort(parts[2], kind="stable")
                    which, owner, place = _firsts(*(p[order] for p in parts), len(names))
                    new = (owner != cut) | ~np.isin(which, seen)
                    yield put(which[new], owner[new], place[new])
                    seen = np.append(seen if cut == text[-1] else seen[:0], which[owner == text[-1]])
                    cut = int(text[-1])

    return rows


def _told(strings: DataFrame) -> list[str] | None:
    """The strings themselves, if they are few enough for every task to hold them."""
    size, n = strings.agg(F.sum(F.octet_length("string")), F.count(F.lit(1))).first()
    return [r[0] for r in strings.collect()] if (size or 0) + 16 * n <= joins.BROADCAST_BYTES // 4 else None


def _in_tasks(strings: list[str], rows: DataFrame, first: bool) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_places(rows.sparkSession.sparkContext.broadcast(strings), first), f"string string, id {kind}, place long")


def _windows(lengths: list[int]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """seed, id and place of every window of the texts, of each length."""
        for batch in batches:
            ids = batch.column(0)
            for i, text in enumerate(batch.column(1).to_pylist()):
                for n in lengths:
                    for begin in range(0, len(text) - n + 1, ROWS):
                        end = min(begin + ROWS, len(text) - n + 1)
                        seeds = pa.array([text[p : p + n] for p in range(begin, end)], pa.string())
                        where = pa.array(np.full(end - begin, i))
                        yield pa.RecordBatch.from_arrays([seeds, ids.take(where), pa.array(np.arange(begin, end))], ["seed", "id", "place"])

    return rows


@dataclass
class SeedIndex:
    """texts: id, text. occurrences: seed, id, place. counts: seed, n, for windows of at most `width` characters."""

    texts: DataFrame
    occurrences: DataFrame
    counts: DataFrame
    width: int

    def dropped(self) -> None:
        """Delete the index's tables, once nothing that reads them is to run."""
        removed(self.occurrences), removed(self.counts)


def seed_index(texts: DataFrame, id_col: str, text_col: str, width: int = 6, shorter: tuple[int, ...] = (), only: DataFrame | None = None) -> SeedIndex:
    """An index of the windows of width characters, and of those of shorter lengths for the strings that are shorter.

    With only (seed), the other windows are left out. Null texts have no windows.
    """
    rows = _texts(texts, id_col, text_col)
    found = rows.mapInArrow(_windows(sorted({width, *shorter})), f"seed string, id {rows.schema['id'].dataType.simpleString()}, place long")
    found = written(found if only is None else found.join(bounded_broadcast(only), "seed", "left_semi"), "seed-index")
    return SeedIndex(rows, found, written(found.groupBy("seed").agg(F.count(F.lit(1)).alias("n")), "seed-counts"), width)


def _seeds(strings: DataFrame, width: int) -> DataFrame:
    """string, begin and seed: the windows of each string; a shorter string is its own."""
    n = F.char_length("string")
    places = F.when(n < width, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), n - width + 1))
    return strings.select("string", F.explode(places).alias("p")).select("string", (F.col("p") - 1).alias("begin"), F.substring("string", F.col("p"), F.lit(width)).alias("seed"))


def _rarest(seeds: DataFrame, counts: DataFrame) -> DataFrame:
    """string, n, seed and begin of each string's rarest window; strings with a window that counts lacks are left out."""
    best = seeds.join(counts, "seed", "left").groupBy("string").agg(F.count_if(F.col("n").isNull()).alias("gone"), F.min(F.struct("n", "seed", "begin")).alias("best"))
    return best.where("gone = 0").select("string", "best.*")


def _different(strings: DataFrame, string_col: str) -> DataFrame:
    return written(strings.select(F.col(f"`{string_col}`").cast("string").alias("string")).where("string <> ''").distinct(), "strings")


def _texts(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return texts.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null")


def occurrences(strings: DataFrame, string_col: str, texts: DataFrame, id_col: str, text_col: str, width: int = 6) -> DataFrame:
    """string, id, place: every place (from 0) of each different string in each text; a text row that repeats counts once.

    Null and empty strings, and null texts, have no places. Overlapping places all count.
    """
    wanted = _different(strings, string_col)
    if (told := _told(wanted)) is not None:
        removed(wanted)
        return _in_tasks(told, _texts(texts, id_col, text_col), False).distinct()
    return _indexed(wanted, texts, id_col, text_col, width)


def holders(strings: DataFrame, string_col: str, texts: DataFrame, id_col: str, text_col: str, width: int = 6) -> DataFrame:
    """string, id, place: each different string with every row of texts that holds it, and its first place there (from 0).

    Rows of texts count one by one, whatever their ids. Null and empty strings, and null texts, have no rows.
    """
    wanted = _different(strings, string_col)
    if (told := _told(wanted)) is not None:
        removed(wanted)
        return _in_tasks(told, _texts(texts, id_col, text_col), True)
    rows = written(_texts(texts, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "texts")
    found = _indexed(wanted, rows, "row", "text", width).groupBy("string", F.col("id").alias("row")).agg(F.min("place").alias("place"))
    return found.join(rows.select("row", "id"), "row").select("string", "id", "place")


def _indexed(wanted: DataFrame, texts: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """occurrences() by the index."""
    n = F.char_length("string")
    shorter = [r[0] for r in wanted.where(n < width).select(n).distinct().collect()]  # at most width - 1 numbers
    seeds = _seeds(wanted, width)
    some = written(seeds.select("seed").distinct(), "seeds")
    index = seed_index(texts, id_col, text_col, width, tuple(shorter), some)
    removed(some)
    hot = F.col("n") > HOT
    chosen = _rarest(seeds, index.counts).withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(hot, SALTS - 1).otherwise(0))))
    many = index.counts.where(hot).select("seed", F.lit(True).alias("many"))
    spread = spread_join(index.occurrences, many, {"seed": "seed"}, F.col("place"), "left")
    spread = spread.withColumn("salt", F.when(F.col("many"), F.pmod(F.xxhash64("id", "place"), F.lit(SALTS)).cast("int")).otherwise(0))
    found = chosen.join(spread, ["seed", "salt"]).select("string", "id", (F.col("place") - F.col("begin")).alias("place")).where("place >= 0")
    checked = spread_join(found, index.texts, {"id": "id"}, F.xxhash64("string"))
    same = F.substring("text", (F.col("place") + 1).cast("int"), n) == F.col("string")
    return checked.where(same).select("string", "id", "place").distinct()


def folded(peptide: Column) -> Column:
    """A peptide or protein as it is looked up: capital letters alone, without modifications, I as L."""
    return remove_modifications(peptide)


def protein_pairs(peptides: DataFrame, peptide_col: str, proteins: DataFrame, protein_col: str, sequence_col: str, width: int = 6) -> DataFrame:
    """peptide (folded, each different one) and protein_id, a row for each protein row whose sequence holds its residues."""
    rows = peptides.select(folded(F.col(f"`{peptide_col}`")).alias("bare"))
    known = proteins.select(F.col(f"`{protein_col}`").cast("string").alias("id"), folded(F.col(f"`{sequence_col}`")).alias("text"))
    return holders(rows, "bare", known, "id", "text", width).select(F.col("string").alias("peptide"), F.col("id").alias("protein_id"))


def map_peptides(peptides: DataFrame, peptide_col: str, proteins: DataFrame, protein_col: str, sequence_col: str, width: int = 6, lists: bool = True) -> DataFrame:
    """peptides with protein_ids (sorted, empty where there is none), protein_id (the first, null without one) and n_proteins.

    A peptide maps to the proteins whose sequence holds its residues, I and L alike and modifications left out. Null and
    empty peptides map to none. A peptide in very many proteins has as long a list, once in every row that has the peptide;
    without lists there is no protein_ids, and rows stay short.
    """
    pairs = protein_pairs(peptides, peptide_col, proteins, protein_col, sequence_col, width).where("protein_id is not null").distinct()
    parts = [F.min("protein_id").alias("protein_id"), F.count(F.lit(1)).cast("int").alias("n_proteins")]
    hits = pairs.groupBy("peptide").agg(*parts, *([F.sort_array(F.collect_list("protein_id")).alias("protein_ids")] if lists else []))
    hits = (hits if lists else written(hits, "mapped")).withColumnRenamed("peptide", "__peptide")
    rows = peptides.withColumn("__bare", folded(F.col(f"`{peptide_col}`")))
    joined = spread_join(rows, hits, {"__bare": "__peptide"}, F.rand(0), "left").drop("__bare")
    some = {"protein_ids": F.coalesce("protein_ids", F.array().cast("array<string>"))} if lists else {}
    return joined.withColumns({"n_proteins": F.coalesce("n_proteins", F.lit(0)), **some})
