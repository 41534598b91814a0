"""Exact duplicate removal that a hot group of copies cannot slow down.

Copies meet in three stages, each grouping by the whole text beside its digest:
within a task (Spark's map-side aggregation), within a salted digest group, and
between the winners of the salts. No stage holds more rows of one text than
there are tasks or salts, so a text with a third of all rows costs no task more
than any other. A digest alone never decides: two texts under one digest form
two groups, and where that happens the rows find their group by the text again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.llm.shared import id_key, one_row_each, text_of
from peakloom.operators.joins import spread_join
from peakloom.storage import written

#: Rows of one text above which they are not dealt by its digest.
HOT = 10_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(text: Column) -> Column:
    """The text with A-Z lower-cased and nothing else changed; null counts as empty."""
    return F.translate(text_of(text), UPPER, UPPER.lower())


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    The largest id of a group is kept. A null id sorts below every other and
    equals only itself, so a group of null ids keeps one of them: keep_id is
    then null and kept is true for each. Null text equals the empty text. An
    empty table gives an empty result, and further columns are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    rows = rows.withColumns({"digest": F.sha2(F.col("norm").cast("binary"), 256), "salt": F.pmod(F.xxhash64("id"), F.lit(salts))})
    salted = rows.groupBy("digest", "norm", "salt").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    winners = salted.groupBy("digest", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"), F.collect_set("salt").alias("used"))
    found = written(winners.select("digest", "keep_id", "n", "used"), "exact-groups")
    by_digest = found.groupBy("digest").agg(
        F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"), F.max("n").alias("n"), F.first("used").alias("used")
    )
    single = by_digest.where((F.col("texts") == 1) & (F.col("n") <= HOT)).select("digest", F.explode("used").alias("salt"), "keep_id", "n")
    # Rows of large groups meet their winner without being dealt by its digest, which one id repeated very often would not part.
    hot = by_digest.where((F.col("texts") == 1) & (F.col("n") > HOT)).select("digest", F.struct("keep_id", "n").alias("hot"))
    hot = written(hot, "exact-hot")
    dealt = spread_join(rows.select("id", "digest", "salt"), hot, {"digest": "digest"}, F.rand(1), "left")
    is_hot = F.col("hot").isNotNull()
    dealt = dealt.withColumn("salt", F.when(is_hot, -1 - F.floor(F.rand(2) * 1024)).otherwise(F.col("salt")).cast("int"))
    single = single.select("digest", F.col("salt").cast("int").alias("salt"), F.struct("keep_id", "n").alias("cold"))
    out = dealt.join(single, ["digest", "salt"], "left").select("id", "digest", F.coalesce("hot", "cold").alias("w"))
    out = out.where("w is not null").select("id", "digest", "w.keep_id", "w.n")
    clash = by_digest.where("texts > 1").select("digest")
    if not clash.isEmpty():  # several texts under one digest: their rows find their group by the text
        some = rows.join(clash, "digest", "left_semi")
        out = out.unionByName(some.join(winners.join(clash, "digest", "left_semi"), ["digest", "norm"]).select("id", "digest", "keep_id", "n"))
    return out.select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64) -> DataFrame:
    """docs with one row of each group of exact_groups, one of those with the largest id; columns and values as they were."""
    groups = exact_groups(docs, id_col, text_col, salts).where("kept")
    winners = groups.select(id_key(F.col(id_col)).alias("__id"), F.col("text_sha256").alias("__content")).distinct()
    norm = normalised(F.col(text_col))
    return one_row_each(docs, {"__id": id_key(F.col(id_col)), "__content": F.sha2(norm.cast("binary"), 256)}, winners)
