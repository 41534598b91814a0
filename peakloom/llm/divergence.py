"""How the sources of each language differ in their words: distances between all pairs of sources, and each source's own terms.

Texts are reduced to counts where they are read. The terms of a language are dealt to
blocks, and a task holds a block as a dense integer matrix of sources by terms: all
pairs of its rows are compared by broadcasting. The blocks' pair matrices are summed,
and their short lists of each source's terms merged. A language with many sources is
cut along both sides of the pair matrix, so that a tile has a bounded size whatever
the number of documents, terms or sources is.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.storage import removed, written

#: Terms of a block, on average, and sources of a tile's side.
TERMS, SOURCES = 128, 128
#: Numbers that a comparison of rows holds at once.
CELLS = 1 << 21
#: Counts that a task holds before it passes them on.
HELD = 200_000
#: Bytes of terms: letters, A to Z lower-cased, and all of UTF-8 beyond ASCII; every other byte is a space.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _counter(most: int):
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """lang, source, term, n (occurrences) and docs (texts with the term), summed over a part of a task; one row without a term for each group."""
        n: dict[tuple, Counter] = {}
        docs: dict[tuple, Counter] = {}
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for group, found in n.items():
                names = [[group[0]] * (len(found) + 1), [group[1]] * (len(found) + 1), [None, *(t.decode(errors="replace") for t in found)]]
                sums = [[0, *found.values()], [0, *(docs[group][t] for t in found)]]
                columns = [*(pa.array(c, pa.string()) for c in names), *(pa.array(c, pa.int64()) for c in sums)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                terms = text.as_py().translate(FOLDED).split()
                found = n.setdefault((lang, source), Counter())
                held -= len(found)
                found.update(terms)
                docs.setdefault((lang, source), Counter()).update(set(terms))
                held += len(found)
                if held > most:
                    yield from out()
                    n, docs, held = {}, {}, 0
        yield from out()

    return counts


def scaled(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """floor(10**9 * part / whole) of positive integers, part at most whole, by long division: nothing leaves 64 bits below 9 * 10**15."""
    out, rest = np.zeros(np.broadcast_shapes(part.shape, whole.shape), np.int64), part
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return out


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of absolute differences of all rows of a and b."""
    out = np.zeros((len(a), len(b)), np.int64)
    step = max(1, CELLS // max(1, b.size))
    for i in range(0, len(a), step):
        out[i : i + step] = np.abs(a[i : i + step, None] - b[None]).sum(axis=-1)
    return out


def _tile(smoothing: int, top: int):
    def rows(frame: pd.DataFrame) -> pd.DataFrame:
        """Partial pair values of two runs of sources over a block's terms; where the runs are one, each source's best terms too."""
        lang, block, side, other = frame[["lang", "block", "side", "other"]].iloc[0]
        is_group = frame["term"].isna().to_numpy()
        groups = frame[is_group].sort_values("place")
        sources, place = groups["source"].to_numpy(), groups["place"].to_numpy()
        vocabulary = int(groups["vocabulary"].iloc[0])
        sizes = groups["size"].to_numpy()[:, None] + smoothing * vocabulary
        cells = frame[~is_group]
        terms, column = np.unique(cells["term"].to_numpy(dtype=object).astype(str), return_inverse=True)
        row = np.searchsorted(place, cells["place"].to_numpy())
        counts, totals = np.zeros((len(place), len(terms)), np.int64), np.zeros(len(terms), np.int64)
        counts[row, column] = cells["n"].to_numpy()
        totals[column] = cells["total"].to_numpy()
        if vocabulary:
            p, absent = 1 + scaled(counts + smoothing, sizes), 1 + scaled(np.full((len(place), 1), smoothing), sizes)
            q = 1 + scaled(totals + smoothing, np.array(int(groups["lang_size"].iloc[0]) + smoothing * vocabulary))
        else:
            p, absent, q = counts, np.zeros((len(place), 1), np.int64), totals
        run = place // SOURCES
        left, right = np.flatnonzero(run == side), np.flatnonzero(run == other)
        # The block's terms that none of these sources has differ by what absence is worth to each; they are counted for
        # all terms in the first block, and taken off in each for the terms that are here.
        values = _distances(p[left], p[right]) + _distances(absent[left], absent[right]) * ((vocabulary if block == 0 else 0) - len(terms))
        a, b = (x.ravel() for x in np.meshgrid(left, right, indexing="ij"))
        values = values.ravel()
        pairs = [(a, b, values)] if side != other else [(a[a != b], b[a != b], values[a != b])]
        if side != other:
            pairs.append((b, a, values))
        out = [pd.DataFrame({"source": sources[i], "part": "pair", "item": sources[j], "value": v}) for i, j, v in pairs]
        if side == other:
            for i in range(len(place)):
                own = np.flatnonzero((counts[i] > 0) & (p[i] > q))
                best = heapq.nsmallest(top, zip(-(p[i] - q)[own], own, strict=True))
                out.append(pd.DataFrame({"source": sources[i], "part": "term", "item": [terms[t] for _, t in best], "value": [-v for v, _ in best]}))
        return pd.concat(out).assign(lang=lang)[["lang", "source", "part", "item", "value"]]

    return rows


def audit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 30, smoothing: int = 5, top: int = 50
) -> DataFrame:
    """Per (lang, source): part, item, value, rank. Part `pair` ranks the language's other sources, part `term` the source's own terms.

    A term is a run of letters and of characters beyond ASCII; only A to Z are lower-cased. A language keeps the terms
    that at least `least` of its rows have. A group gives each kept term 1 + floor(10**9 (count + smoothing) / (N +
    smoothing V)), N being its occurrences of all V kept terms, and the language likewise over all its rows. A pair's
    value is the sum of the absolute differences over the kept terms, 0 if there are none. Terms are those that the
    group has and to which it gives more than its language, by the difference, the first `top`. Ranks run from 1,
    values falling, ties by item in the order of UTF-8.

    Null text, language and source count as empty, and a repeated row counts each time. A group without a term has its
    pairs; a language with one source has none. An empty table gives an empty result; further columns are not looked
    at. The pairs of a language's sources are as many as the result has rows; its sources are numbered in one task.
    """
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    read = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).cast("binary").alias("text"))
    counts = read.mapInArrow(_counter(HELD), "lang string, source string, term string, n long, docs long")
    # One exchange: the sums of a group's term and those of a language's term are made where all counts of (lang, term) meet.
    counts = counts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    counts = counts.withColumns({
        "total": F.sum("n").over(of_term), "docs": F.sum("docs").over(of_term), "first": (F.col("source") == F.min("source").over(of_term)).cast("long"),
    })
    kept = written(counts.where(F.col("term").isNull() | (F.col("docs") >= least)), "kept-terms")
    by_lang = Window.partitionBy("lang")  # a row for each source
    is_term = F.col("term").isNotNull()
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.sum(F.when(is_term, F.col("first")).otherwise(0)).alias("firsts"))
    groups = groups.select(
        "lang", "source", "size", F.sum("firsts").over(by_lang).alias("vocabulary"), F.sum("size").over(by_lang).alias("lang_size"),
        (F.row_number().over(by_lang.orderBy("source")) - 1).alias("place"), F.count(F.lit(1)).over(by_lang).alias("sources"),
    )
    groups = written(groups.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("vocabulary") / TERMS))), "term-groups")
    cells = kept.where(is_term).join(groups, ["lang", "source"])
    cells = cells.withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")))
    marks = groups.withColumns({"block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), **{c: F.lit(None).cast(k) for c, k in (("term", "string"), ("n", "long"), ("total", "long"))}})
    columns = ["lang", "block", "source", "place", "sources", "size", "vocabulary", "lang_size", "term", "n", "total"]
    tiles = cells.select(columns).unionByName(marks.select(columns))
    run, runs = F.floor(F.col("place") / SOURCES), F.ceil(F.col("sources") / SOURCES)
    tiles = tiles.withColumn("with", F.explode(F.sequence(F.lit(0), runs - 1)))
    tiles = tiles.withColumns({"side": F.least(run, F.col("with")), "other": F.greatest(run, F.col("with"))}).drop("with", "sources")
    found = tiles.groupBy("lang", "block", "side", "other").applyInPandas(_tile(smoothing, top), "lang string, source string, part string, item string, value long")
    found = written(found, "divergence")
    removed(kept)
    by_group = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.col("item"))
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(by_group))
    pairs = ranked(found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")))
    return pairs.unionByName(ranked(found.where("part = 'term'")).where(F.col("rank") <= top))
