"""Compression of vectors to codes: a codebook for each part, learned by Lloyd's rounds with Elkan's bounds.

All distances are those of integers, so results do not depend on how rows are dealt
to tasks. Between rounds each vector keeps, for each of its parts, the entry it is
assigned to, an upper bound of the distance to it and a lower bound of the distance
to every entry; when entries move, the bounds move as far. An entry is passed over
only if the bounds prove it strictly farther than the assigned one, so that what is
left, ties included, is settled by integer distances. Rounds end in tables, and the
codebooks, a number of integers that does not depend on the rows, pass the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.operators.joins import bounded_broadcast
from peakloom.storage import removed, written

#: Bits within which the squared distance of two vectors must stay.
LONGEST = 62
#: Relative slack of bounds, far above the rounding errors of a square root and a sum.
SLACK = 1e-12
#: Copies of a label's total where there are too many labels to broadcast.
SALTS = 16


@dataclass(frozen=True)
class Codebooks:
    """Entries (parts, entries, width) and how far the last round moved each, rounded up."""

    entries: np.ndarray
    moved: np.ndarray

    @property
    def width(self) -> int:
        return self.entries.shape[2]

    def digest(self) -> str:
        """SHA-256 of all components, decimal, joined by commas, by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    gap = x - y
    return np.einsum("...i,...i->...", gap, gap)


def _above(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)) * (1 + SLACK)


def _below(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)) * (1 - SLACK)


def nearest(x: np.ndarray, entries: np.ndarray, moved: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Assign one part of some vectors anew; at, upper and lower are changed in place. How many distances were computed.

    x holds integers (rows, width), at the entries so far, upper and lower (rows, entries) the bounds before entries
    moved. Ties go to the lower index.
    """
    count = len(entries)
    upper += moved[at]
    upper *= 1 + SLACK
    lower -= moved + SLACK * lower
    np.maximum(lower, 0, out=lower)
    half = _below(_squares(entries[:, None], entries[None])) / 2
    np.fill_diagonal(half, np.inf)
    closest = half.min(axis=1)
    live = np.flatnonzero(upper >= closest[at])
    own = _squares(x[live], entries[at[live]])
    upper[live], lower[live, at[live]] = _above(own), _below(own)
    done = len(live)
    some = upper[live] >= closest[at[live]]
    live, own = live[some], own[some]
    for j in range(count):
        a, u = at[live], upper[live]
        test = np.flatnonzero((a != j) & (u >= lower[live, j]) & (u >= half[a, j]))
        rows = live[test]
        found = _squares(x[rows], entries[j])
        done += len(rows)
        lower[rows, j] = _below(found)
        better = (found < own[test]) | ((found == own[test]) & (j < at[rows]))
        rows, found = rows[better], found[better]
        at[rows], upper[rows], own[test[better]] = j, _above(found), found
    return done


def _table(column: pa.Array, rows: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(rows, -1)


def _listed(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(values.ravel(), kind))


def _integers(scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """id, label and vector of integers, of the rows without null and non-finite components; the vector is null if distances may leave 64 bits."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(2).is_valid())
            sizes = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            values = pc.cast(pc.list_flatten(batch.column(2)), pa.float64()).to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore", invalid="ignore"):
                scaled = np.floor(values * scale)
            inside = np.abs(scaled) <= np.repeat(np.minimum(np.sqrt(2.0**LONGEST / np.maximum(sizes, 1)) / 2, 2**30), sizes)

            def some(flags: np.ndarray, sizes: np.ndarray = sizes, ends: np.ndarray = ends) -> np.ndarray:
                so_far = np.append(0, np.cumsum(flags))
                return so_far[ends] > so_far[ends - sizes]

            odd, far = some(~np.isfinite(values)), some(~inside)
            scaled = np.where(inside, scaled, 0).astype(np.int32)
            vector = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(scaled), mask=pa.array(far))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), vector], ["id", "label", "vector"]).filter(pa.array(~odd))

    return rows


def _smallest(count: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """id and vector of a task's smallest ids, nulls last; of a repeated id the vector that sorts first."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        for batch in batches:
            kind = batch.schema.field(0).type
            ids = sorted({*best, *pc.unique(batch.column(0)).to_pylist()}, key=lambda i: (1, 0) if i is None else (0, i))[:count]
            best = {i: best[i] for i in ids if i in best}
            wanted = batch.filter(pc.is_in(batch.column(0), pa.array(ids, kind)))
            for i, v in zip(wanted.column(0).to_pylist(), wanted.column(1).to_pylist(), strict=True):
                best[i] = min(v, best.get(i, v))
        if best:
            yield pa.RecordBatch.from_arrays([pa.array(list(best), kind), pa.array(list(best.values()), pa.list_(pa.int32()))], ["id", "vector"])

    return rows


def _seeds(vectors: DataFrame, count: int, parts: int) -> Codebooks | None:
    """Codebooks of the vectors with the smallest ids; None without vectors."""
    order = F.col("id").asc_nulls_last()
    found = vectors.select("id", "vector").mapInArrow(_smallest(count), vectors.select("id", "vector").schema)
    first = found.groupBy("id").agg(F.min("vector").alias("vector")).orderBy(order).limit(count).collect()
    if not first:
        return None
    entries = np.array([r["vector"] for r in first], np.int64)
    entries = entries.reshape(len(first), parts, entries.shape[1] // parts).swapaxes(0, 1).copy()
    return Codebooks(entries, np.zeros(entries.shape[:2]))


def _assigned(books: Codebooks, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A round's assignment: id, label, vector, at, upper, lower; in the last one id, label, code and error."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, count, width = books.entries.shape
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            vector = _table(batch.column("vector"), n).reshape(n, parts, width) if width else np.zeros((n, parts, 0), np.int32)
            known = "at" in batch.schema.names
            at = _table(batch.column("at"), n).astype(np.int64) if known else np.zeros((n, parts), np.int64)
            upper = _table(batch.column("upper"), n).astype(np.float64) if known else np.full((n, parts), np.inf)
            lower = _table(batch.column("lower"), n).astype(np.float64).reshape(n, parts, count) if known else np.zeros((n, parts, count))
            error = np.zeros(n, np.int64)
            for p in range(parts):
                x = vector[:, p].astype(np.int64)
                a, u, l = at[:, p].copy(), upper[:, p].copy(), lower[:, p].copy()
                nearest(x, books.entries[p], books.moved[p], a, u, l)
                at[:, p], upper[:, p], lower[:, p] = a, u, l
                error += _squares(x, books.entries[p][a]) if last else 0
            if last:
                codes = pa.array([r.tobytes().hex() for r in at.astype(np.uint8)])
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), codes, pa.array(error)], ["id", "label", "code", "error"])
                continue
            # Kept as 32-bit numbers: an upper bound goes up to the next one, a lower bound down.
            upper = np.nextafter(upper.astype(np.float32), np.float32(np.inf))
            lower = np.maximum(np.nextafter(lower.reshape(n, -1).astype(np.float32), np.float32(-1)), 0)
            state = [_listed(at.astype(np.int32), pa.int32()), _listed(upper, pa.float32()), _listed(lower, pa.float32())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("vector"), *state], ["id", "label", "vector", "at", "upper", "lower"])

    return rows


def _summed(parts: int, count: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's sums: part, entry, place (the number of vectors at -1) and value."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, count, width + 1), np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            at = _table(batch.column("at"), n)
            vector = _table(batch.column("vector"), n).reshape(n, parts, width) if width else np.zeros((n, parts, 0), np.int64)
            for p in range(parts):
                np.add.at(sums[p, :, 0], at[:, p], 1)
                for e in range(count):
                    sums[p, e, 1:] += vector[at[:, p] == e, p].sum(axis=0, dtype=np.int64)
        part, entry, place = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array((place - 1).astype(np.int32)), pa.array(sums[part, entry, place])],
            ["part", "entry", "place", "value"],
        )

    return rows


def _moved(books: Codebooks, state: DataFrame) -> Codebooks:
    """Each entry at the componentwise floor of its vectors' mean; one without vectors stays."""
    parts, count, width = books.entries.shape
    partial = state.select("vector", "at").mapInArrow(_summed(parts, count, width), "part int, entry int, place int, value long")
    sums = np.zeros((parts, count, width + 1), np.int64)
    for r in partial.groupBy("part", "entry", "place").agg(F.sum("value").alias("value")).collect():  # parts x entries x (width + 1) rows
        sums[r["part"], r["entry"], r["place"] + 1] = r["value"]
    size = sums[..., :1]
    entries = np.where(size > 0, sums[..., 1:] // np.maximum(size, 1), books.entries)
    return Codebooks(entries, _above(_squares(entries, books.entries)))


def learn(vectors: DataFrame, parts: int, count: int, rounds: int) -> tuple[Codebooks | None, DataFrame | None]:
    """Codebooks after the rounds, and the table of the last round's bounds. vectors: id, label, vector (integers, one length)."""
    books = _seeds(vectors, count, parts)
    if books is None:
        return None, None
    kinds = dict(vectors.dtypes)
    schema = f"id {kinds['id']}, label {kinds['label']}, vector array<int>, at array<int>, upper array<float>, lower array<float>"
    state, before = vectors, None
    for _ in range(rounds):
        state = written(state.mapInArrow(_assigned(books, False), schema), "elkan-round")
        if before is not None:
            removed(before)
        before = state
        books = _moved(books, state)
    return books, state


def compress(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6,
    scale: int = 4096,
) -> DataFrame:
    """One row per vector: id, code, error, label_error, codebooks_sha256.

    A component x counts as floor(scale * x). A vector is cut into equal consecutive parts; each part position has a
    codebook, which starts as that part of the vectors with the smallest ids. A round assigns each part to the nearest
    entry and moves each entry to the componentwise floor of its parts' mean; after the rounds parts are assigned once
    more. code has two hex digits for each part, error is the sum of the squared distances, label_error the sum of
    error over the rows of the same label.

    Rows whose vector is null or has a null or non-finite component are left out. Of a repeated id one vector, that
    which sorts first, can start an entry; every row gets its code. A null id comes after all others; null labels are
    one label. Fewer ids than entries give as many entries. The length of a vector is that of the one with the
    smallest id, which the parts must divide (an error otherwise). Vectors of another length have no distance to the
    entries, and those with scaled components above 2**30 / sqrt(components) none that 64 bits are sure to
    hold: their code and error are null. An empty table gives an empty result; further columns are not looked at.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index has two hex digits, so there are 1 to 256 entries")
    named = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").alias("vector"))
    kinds = dict(named.dtypes)
    vectors = written(named.mapInArrow(_integers(scale), f"id {kinds['id']}, label {kinds['label']}, vector array<int>"), "vectors")
    known = F.struct(F.col("id").isNull(), "id", F.col("vector"))
    first = vectors.where("vector is not null").agg(F.min_by(F.size("vector"), known).alias("n")).first()["n"]
    if first is not None and first % parts:
        raise ValueError(f"{parts} parts do not divide a vector of {first} components")
    equal = F.col("vector").isNotNull() & (F.size("vector") == F.lit(first if first is not None else -1))
    books, state = learn(vectors.where(equal), parts, entries, rounds)
    out = vectors.where(~equal).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if books is not None:
        coded = (state if state is not None else vectors.where(equal)).mapInArrow(
            _assigned(books, True), f"id {kinds['id']}, label {kinds['label']}, code string, error long"
        )
        out = coded.unionByName(out)
    out = written(out, "vector-codes")
    for done in (state, vectors):
        if done is not None:
            removed(done)
    totals = written(out.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "of")
    small = bounded_broadcast(totals)
    if small is totals:  # more labels than can be broadcast: salted, as one of them may be hot
        out = out.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
        small = totals.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = out.join(small, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("s")))
    else:
        joined = out.join(small, F.col("label").eqNullSafe(F.col("of")))
    digest = books.digest() if books is not None else None
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).cast("string").alias("codebooks_sha256"))
