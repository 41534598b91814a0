"""Amino-acid and peptide metrics: matches, precision and recall, curves, thresholds at a false discovery rate."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.constants import RESIDUE_MASSES
from peakloom.functions.masses import masses
from peakloom.operators import selection
from peakloom.operators.ordered import running
from peakloom.storage import removed, written


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, starts and sizes of a column of lists of doubles; null lists are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy().astype(np.int64)
    sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    return column.values.to_numpy(zero_copy_only=False).astype(np.float64), offsets[:-1], sizes


def walked(targets: pa.Array, predicted: pa.Array, cumulative: float, individual: float) -> np.ndarray:
    """matched_residues of two columns; all rows of a batch walk side by side."""
    (t, t_at, t_size), (p, p_at, p_size) = _lists(targets), _lists(predicted)
    t, p = np.append(t, 0.0), np.append(p, 0.0)
    count = np.zeros(len(t_at), np.int32)
    row = np.flatnonzero((t_size > 0) & (p_size > 0))
    i, j, t_end, p_end = t_at[row], p_at[row], (t_at + t_size)[row], (p_at + p_size)[row]
    a, b = t[i], p[j]
    while len(row):
        near = np.abs(a - b) < cumulative
        lighter = ~near & (b > a)
        count[row] += near & (np.abs(t[i] - p[j]) < individual)
        i, j = i + (near | lighter), j + ~lighter
        live = (i < t_end) & (j < p_end)
        row, i, j, t_end, p_end, near, lighter, a, b = (x[live] for x in (row, i, j, t_end, p_end, near, lighter, a, b))
        a, b = a + np.where(near | lighter, t[i], 0.0), b + np.where(lighter, 0.0, p[j])
    return count


def matched_residues(target: Column, predicted: Column, cumulative: float = 0.5, individual: float = 0.1) -> Column:
    """Residues that agree in a walk along two mass lists.

    Where the prefix masses are within `cumulative`, a pair of residues counts if their masses are within
    `individual`, and both lists advance; else the list of the lighter prefix advances. Each step depends on the one
    before, which column functions can only say by an interpreted fold; Arrow batches walk many rows at once.
    """

    @F.arrow_udf("int")
    def walk(t: pa.Array, p: pa.Array) -> pa.Array:
        return pa.array(walked(t, p, cumulative, individual))

    return walk(target, predicted)


def matches(
    df: DataFrame, target: str = "targets", predicted: str = "predictions", table: Mapping[str, float] = RESIDUE_MASSES, strict: bool = True
) -> DataFrame:
    """df with n_targ, n_pred, n_match and pep_match (int) for columns of tokens."""
    empty = F.array().cast("array<string>")
    found = df.withColumns({
        "__t": masses(F.coalesce(F.col(target), empty), table, strict), "__p": masses(F.coalesce(F.col(predicted), empty), table, strict),
    })
    found = found.withColumns({"n_targ": F.size("__t"), "n_pred": F.size("__p"), "n_match": matched_residues(F.col("__t"), F.col("__p"))})
    whole = (F.col("n_targ") == F.col("n_pred")) & (F.col("n_match") == F.col("n_targ"))
    return found.withColumn("pep_match", whole.cast("int")).drop("__t", "__p")


def matches_by_band(df: DataFrame, id_col: str, target: str, predicted: str, table: Mapping[str, float] = RESIDUE_MASSES) -> DataFrame:
    """id and n_match by a join of prefix masses within each id; equal to the walk where every mass is at least 1."""
    by_id = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)

    def prefixes(column: str, name: str) -> DataFrame:
        rows = df.select(id_col, F.posexplode(masses(F.col(column), table)).alias("pos", name))
        return rows.withColumn(f"cum_{name}", F.sum(name).over(by_id)).drop("pos")

    a, b = prefixes(target, "a"), prefixes(predicted, "b")
    near = a.join(b, id_col).where((F.abs(F.col("cum_a") - F.col("cum_b")) < 0.5) & (F.abs(F.col("a") - F.col("b")) < 0.1))
    return df.select(id_col).join(near.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_match")), id_col, "left").select(
        id_col, F.coalesce("n_match", F.lit(0)).alias("n_match")
    )


def _ratios() -> list[Column]:
    none = F.col("n_pred_pep") == 0
    return [
        F.when(none, 1.0).otherwise(F.try_divide("n_match_aa", "n_pred_aa")).alias("aa_prec"),
        F.try_divide("n_match_aa", "n_targ_aa").alias("aa_recall"),
        F.try_divide("n_match_pep", "n_targ_pep").alias("pep_recall"),
        F.when(none, 1.0).otherwise(F.try_divide("n_match_pep", "n_pred_pep")).alias("pep_prec"),
    ]


def _sums(counts: Column) -> list[Column]:
    return [
        F.sum("n_targ").alias("n_targ_aa"), F.sum(F.when(counts, F.col("n_pred")).otherwise(0)).alias("n_pred_aa"),
        F.sum(F.when(counts, F.col("n_match")).otherwise(0)).alias("n_match_aa"), F.count(F.lit(1)).alias("n_targ_pep"),
        F.count_if(counts).alias("n_pred_pep"), F.sum(F.when(counts, F.col("pep_match")).otherwise(0)).alias("n_match_pep"),
    ]


def precision_recall(matched: DataFrame, by: tuple[str, ...] = (), confidence: str | None = None, threshold: Column | float | None = None) -> DataFrame:
    """One row (for each group) of counts and of precision and recall of residues and peptides.

    matched comes from matches(). Predictions below the threshold, and empty ones, count neither as predicted nor
    as matched; without any, both precisions are 1. Without a confidence or a threshold all predictions count. No
    targets give null.
    """
    counts = F.col("n_pred") > 0
    if confidence is not None and threshold is not None:
        counts = counts & F.coalesce(F.col(confidence) >= threshold, F.lit(False))
    return matched.groupBy(*by).agg(*_sums(counts)).select(*by, "n_targ_aa", "n_pred_aa", "n_match_aa", "n_targ_pep", "n_pred_pep", "n_match_pep", *_ratios())


def precision_recall_rollup(matched: DataFrame, group: str) -> DataFrame:
    """precision_recall for each group and for all rows (group "all") in one pass."""
    rows = matched.rollup(group).agg(F.grouping(group).alias("__all"), *_sums(F.col("n_pred") > 0))
    name = F.when(F.col("__all") == 1, "all").otherwise(F.col(group))
    return rows.select(name.alias(group), "n_targ_aa", "n_pred_aa", "n_match_aa", "n_targ_pep", "n_pred_pep", "n_match_pep", *_ratios())


def _ids(target: pa.Array, predicted: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Tokens of two columns of lists as integers, with starts and sizes of the lists; null lists are empty, a null token is one of its own."""
    sides = []
    for column in (target, predicted):
        offsets = column.offsets.to_numpy().astype(np.int64)
        sides.append((column.values, offsets[:-1], np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)))
    both = pa.concat_arrays([values.cast(pa.string()) for values, _, _ in sides]).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    cut = len(sides[0][0])
    return [(ids.astype(np.int64), at, size) for ids, (_, at, size) in zip((both[:cut], both[cut:]), sides, strict=True)]


def _bits_distance(pattern: np.ndarray, text: np.ndarray) -> int:
    """Edit distance of two arrays of ids, the bits of one column of the table in one integer of any length."""
    m = len(pattern)
    if not m:
        return len(text)
    at: dict[int, int] = {}
    for i, t in enumerate(pattern.tolist()):
        at[t] = at.get(t, 0) | 1 << i
    whole, last = (1 << m) - 1, 1 << (m - 1)
    up, down, score = whole, 0, m
    for t in text.tolist():
        eq = at.get(t, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right, left = down | (~(diagonal | up) & whole), up & diagonal
        score += bool(right & last) - bool(left & last)
        right, left = (right << 1 | 1) & whole, left << 1 & whole
        up, down = left | (~((eq | down) | right) & whole), right & (eq | down)
    return score


def edit_distances(target: pa.Array, predicted: pa.Array) -> np.ndarray:
    """Edit distance of the lists of each row, whatever the number of different tokens is.

    A column of the table of distances is held as the bits of its differences. The lists of up to 63 tokens of a batch
    go through their columns side by side, one machine word for each row; longer ones one by one, in long integers.
    """
    (t, t_at, t_size), (p, p_at, p_size) = _ids(target, predicted)
    out = np.where(t_size == 0, p_size, np.where(p_size == 0, t_size, 0)).astype(np.int64)
    some = (t_size > 0) & (p_size > 0)
    for row in np.flatnonzero(some & (t_size > 63)):
        out[row] = _bits_distance(t[t_at[row] : t_at[row] + t_size[row]], p[p_at[row] : p_at[row] + p_size[row]])
    rows = np.flatnonzero(some & (t_size <= 63))
    rows = rows[np.argsort(-p_size[rows], kind="stable")]  # rows whose text has ended are then at the end
    if not len(rows):
        return out
    size, widest = t_size[rows], int(t_size[rows].max())
    place = np.arange(widest)
    pattern = np.where(place < size[:, None], t[np.minimum(t_at[rows][:, None] + place, len(t) - 1)], -1)
    powers = np.uint64(1) << place.astype(np.uint64)
    whole, last = (np.uint64(1) << size.astype(np.uint64)) - np.uint64(1), np.uint64(1) << (size - 1).astype(np.uint64)
    up, down, score, one = whole.copy(), np.zeros(len(rows), np.uint64), size.astype(np.int64), np.uint64(1)
    for j in range(int(p_size[rows[0]])):
        n = int(np.searchsorted(-p_size[rows], -j, "left"))  # rows with more than j tokens
        token = p[p_at[rows[:n]] + j]
        eq = ((pattern[:n] == token[:, None]) * powers).sum(axis=1, dtype=np.uint64)
        u, d, w, top = up[:n], down[:n], whole[:n], last[:n]
        diagonal = (((eq & u) + u) ^ u) | eq | d
        right, left = d | (~(diagonal | u) & w), u & diagonal
        score[:n] += ((right & top) != 0).astype(np.int64) - ((left & top) != 0)
        right, left = (right << one | one) & w, (left << one) & w
        up[:n], down[:n] = left | (~((eq | d) | right) & w), right & (eq | d)
    out[rows] = score
    return out


def edits(target: Column, predicted: Column) -> Column:
    """Edit distance of two columns of token lists."""

    @F.arrow_udf("long")
    def distance(t: pa.Array, p: pa.Array) -> pa.Array:
        return pa.array(edit_distances(t, p))

    return distance(target, predicted)


def aa_error_rate(df: DataFrame, target: str, predicted: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Edits between token lists over the targets' tokens; I counts as L. Null lists are empty."""
    same = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda t: F.when(t == "I", "L").otherwise(t))
    rows = df.select(*by, same(target).alias("t"), same(predicted).alias("p"))
    rows = rows.select(*by, edits(F.col("t"), F.col("p")).alias("edits"), F.size("t").alias("n"))
    return rows.groupBy(*by).agg(F.sum("edits").alias("n_edits"), F.sum("n").alias("n_ref")).withColumn("aa_er", F.try_divide("n_edits", "n_ref"))


def thresholds(matched: DataFrame, confidence: str, n: int = 20) -> DataFrame:
    """k and the confidence at rank floor(rows * k / n) for k below n, and the last, of the non-null in ascending order, by selection."""
    known = written(matched.where(F.col(confidence).isNotNull()).select(F.col(confidence).cast("double").alias("c")), "confidences")
    rows = known.count()
    ranks = {k: rows if k == n else rows * k // n + 1 for k in range(n + 1)} if rows else {}
    found = selection.at_ranks(known, selection.double_bits(F.col("c")), list(ranks.values()))
    removed(known)
    return matched.sparkSession.createDataFrame([(k, selection.double_of(found[r][0])) for k, r in ranks.items()], "k int, threshold double")


def pr_curve(matched: DataFrame, confidence: str = "confidence", n: int = 20) -> DataFrame:
    """k, threshold, pep_recall, pep_prec at n + 1 thresholds.

    Each row falls into the bucket of the highest threshold it reaches, buckets are summed once, and the sums are
    accumulated from the top: a pass over the data, whatever n is. The thresholds, n + 1 numbers, pass the driver.
    """
    matched = written(matched.select(confidence, "n_pred", "pep_match"), "matched")
    cut = sorted(((r["k"], r["threshold"]) for r in thresholds(matched, confidence, n).collect()), key=lambda x: x[0])
    spark = matched.sparkSession
    if not cut:
        return spark.createDataFrame([], "k int, threshold double, pep_recall double, pep_prec double")
    edges = F.array(*[F.lit(float(t)) for _, t in cut])
    reached = F.size(F.filter(edges, lambda t: F.col(confidence) >= t)) - 1
    usable = (F.col("n_pred") > 0) & F.col(confidence).isNotNull()
    sums = matched.groupBy(F.when(usable, reached).otherwise(-1).alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("pep_match").alias("m")
    )
    points = spark.createDataFrame(cut, "k int, threshold double").join(sums, "k", "full")
    above = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    points = points.select(
        "k", "threshold", F.sum(F.coalesce("n", F.lit(0))).over(above).alias("n"),
        F.sum(F.coalesce("m", F.lit(0))).over(above).alias("m"), F.sum(F.coalesce("n", F.lit(0))).over(everything).alias("all"),
    )
    return points.where("k >= 0").select(
        "k", "threshold", (F.col("m") / F.col("all")).alias("pep_recall"), F.when(F.col("n") == 0, 1.0).otherwise(F.try_divide("m", "n")).alias("pep_prec")
    )


def pr_auc(curve: DataFrame) -> DataFrame:
    """One row: auc, by trapezoids over the points of pr_curve in order of falling threshold."""
    by_k = Window.orderBy(F.desc("k"))
    steps = curve.select(
        (F.col("pep_recall") - F.lag("pep_recall").over(by_k)).alias("width"), F.col("pep_prec").alias("p"), F.lag("pep_prec").over(by_k).alias("q")
    )
    return steps.agg(F.sum(F.col("width") * (F.col("p") + F.col("q")) / 2).alias("auc"))


def running_precision(matched: DataFrame, confidence: str = "confidence", order: str = "id") -> DataFrame:
    """id, confidence and pep_match of matched, with rank, matches found and precision among the predictions of that confidence or more, ties by id."""
    ranked = running(matched.select(order, confidence, "pep_match"), [F.col(confidence).desc(), F.col(order)], {"found": F.col("pep_match")})
    return ranked.withColumn("precision", F.col("found") / F.col("rank"))


def recall_at_fdr(matched: DataFrame, fdr: float = 0.05, confidence: str = "confidence", order: str = "id") -> DataFrame:
    """One row: rank, recall and confidence threshold of the last rank with precision above 1 - fdr; 0, 0 and 1 if none."""
    ranked = running_precision(matched, confidence, order)
    good = F.col("precision") > 1 - fdr
    last = F.max_by(F.struct("rank", "found", F.col(confidence).alias("c")), F.when(good, F.col("rank")))
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("g"), last.alias("last")).select(
        F.when(F.col("g") > 0, F.col("last.rank")).otherwise(0).cast("bigint").alias("rank"),
        F.when(F.col("g") > 0, F.col("last.found") / F.col("n")).otherwise(0.0).alias("recall"),
        F.when(F.col("g") > 0, F.col("last.c")).otherwise(1.0).alias("threshold"),
    )


def recall_at_fdr_by(matched: DataFrame, by: str, fdr: float = 0.05, confidence: str = "confidence", order: str = "id") -> DataFrame:
    """recall_at_fdr for each group; ranks run within groups over range partitions, so a large group spreads over many tasks."""
    ranked = running(matched.select(by, confidence, order, "pep_match"), [F.col(confidence).desc(), F.col(order)], {"found": F.col("pep_match")}, by=by)
    good = F.col("found") / F.col("rank") > 1 - fdr
    last = F.max_by(F.struct("rank", "found", F.col(confidence).alias("c")), F.when(good, F.col("rank")))
    return ranked.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("g"), last.alias("last")).select(
        by, F.when(F.col("g") > 0, F.col("last.found") / F.col("n")).otherwise(0.0).alias("recall"),
        F.when(F.col("g") > 0, F.col("last.c")).otherwise(1.0).alias("threshold"),
    )


def threshold_counts(df: DataFrame, confidence: str, flags: dict[str, Column], points: int = 50) -> DataFrame:
    """threshold and the number of rows at or above it, for each flag, over a grid of thresholds from 0 to 1.

    One pass makes a histogram; the counts are its sums from the top.
    """
    c, last = F.col(confidence), points - 1
    cell = F.floor(c * last).cast("int")  # but for rounding
    cell = F.when((cell + 1) / last <= c, cell + 1).when(cell / last > c, cell - 1).otherwise(cell)
    sums = df.where(c.isNotNull()).groupBy(F.least(F.lit(last), cell).alias("k")).agg(*[F.count_if(c).alias(n) for n, c in flags.items()])
    grid = df.sparkSession.range(points).select(F.col("id").cast("int").alias("k"))
    above = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    rows = grid.join(sums, "k", "left")
    return rows.select((F.col("k") / (points - 1)).alias("threshold"), *[F.sum(F.coalesce(n, F.lit(0))).over(above).alias(n) for n in flags])


def counts_above(df: DataFrame, confidence: str, flags: dict[str, Column], points: int = 50) -> DataFrame:
    """threshold and the number of rows strictly above it, for each flag, over a grid of thresholds from 0 to 1, whatever rounding does to a grid point."""
    known = df.where(F.col(confidence).isNotNull())
    sums = known.groupBy(_cell_below(F.col(confidence), points - 1).alias("k")).agg(*[F.count_if(c).alias(n) for n, c in flags.items()])
    grid = df.sparkSession.range(points).select(F.col("id").cast("int").alias("k"))
    above = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)  # a row for each grid point
    rows = grid.join(sums, "k", "left")
    return rows.select((F.col("k") / (points - 1)).alias("threshold"), *[F.sum(F.coalesce(n, F.lit(0))).over(above).alias(n) for n in flags])


def _cell_below(c: Column, last: int) -> Column:
    """The last of the points 0 to last whose last-th part is below c; -1 if none is."""
    cell = F.ceil(c * last).cast("int") - 1  # but for rounding
    cell = F.when((cell + 1) / last < c, cell + 1).when(cell / last >= c, cell - 1).otherwise(cell)
    return F.greatest(F.lit(-1), F.least(F.lit(last), cell))


def strict_curve(matched: DataFrame, confidence: str = "confidence", points: int = 100) -> DataFrame:
    """threshold, tp, fp, fn, precision and recall over a grid of thresholds from 0 to 1.

    Predictions of a confidence strictly above the threshold count as tp if they match and as fp if not; matches that
    fail it are fn. Ratios of nothing are null. One pass makes a histogram; the counts are its sums from the top.
    """
    c, last = F.col(confidence), points - 1
    hit = F.coalesce(F.col("pep_match") == 1, F.lit(False))
    known = matched.where(c.isNotNull())
    sums = known.groupBy(_cell_below(c, last).alias("k")).agg(F.count_if(hit).alias("m"), F.count_if(~hit).alias("x"))
    grid = matched.sparkSession.range(-1, points).select(F.col("id").cast("int").alias("k"))
    above = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    below = Window.orderBy(F.desc("k")).rowsBetween(1, Window.unboundedFollowing)
    n = lambda c, w: F.sum(F.coalesce(c, F.lit(0))).over(w)
    rows = grid.join(sums, "k", "left").select("k", n("m", above).alias("tp"), n("x", above).alias("fp"), F.coalesce(n("m", below), F.lit(0)).alias("fn"))
    return rows.where("k >= 0").select(
        (F.col("k") / last).alias("threshold"), "tp", "fp", "fn", F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"),
        F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"),
    )


def report(
    matched: DataFrame, fdr: float = 0.05, max_ppm: float = 20, min_confidence: float = 1e-4, confidence: str = "confidence", ppm: str = "delta_mass_ppm",
    by: str | None = None, order: str = "id",
) -> DataFrame:
    """The evaluation report in long form: section and the columns of precision_recall, with the group where there is `by`.

    Sections: all predictions; those at the false discovery rate; those within max_ppm; those above min_confidence.
    Predictions that a filter fails count as empty, their targets stay. Groups each have their own threshold. The
    matches are computed and written once; all sections are sums of one pass over them.
    """
    groups = [by] if by is not None else []
    rows = written(matched.select(*groups, order, confidence, F.col(ppm).alias("__ppm"), "n_targ", "n_pred", "n_match", "pep_match"), "matches")
    at = recall_at_fdr_by(rows, by, fdr, confidence, order).drop("recall") if by is not None else recall_at_fdr(rows, fdr, confidence, order).select("threshold")
    joined = rows.join(F.broadcast(at.withColumnRenamed(by, "__g")), F.col(by).eqNullSafe(F.col("__g"))) if by is not None else rows.join(F.broadcast(at))
    some = F.col("n_pred") > 0
    conditions = {
        "all": some, "fdr": some & F.coalesce(F.col(confidence) >= F.col("threshold"), F.lit(False)),
        "ppm": some & F.coalesce(F.col("__ppm") < max_ppm, F.lit(False)), "confidence": some & F.coalesce(F.col(confidence) > min_confidence, F.lit(False)),
    }
    sections = F.array(*[F.struct(F.lit(n).alias("section"), *_sums(c)) for n, c in conditions.items()])
    counts = joined.groupBy(*groups).agg(sections.alias("s")).select(*groups, F.inline("s"))
    return counts.select(*groups, "section", "n_targ_aa", "n_pred_aa", "n_match_aa", "n_targ_pep", "n_pred_pep", "n_match_pep", *_ratios())
