"""From raw documents to packed sequences: language, quality, exact copies, near copies, packing.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept and returns a DataFrame, with the
columns of documents in all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.llm import exact_dedup, langid, minhash, packing, quality_rules
from peakloom.llm.shared import as_rows, bucket_of, content_of, from_rows, id_key, table, text_of
from peakloom.storage import made, removed_since, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str, margin: float = 1.1) -> DataFrame:
    """Drops texts without a letter and those whose best language hardly beats an even share among the languages.

    The model is learned from the stage's own rows outside crc32 bucket 2 of 4. Every row is judged by its own
    id and text, so null and repeated ids are as good as others.
    """
    bucket = bucket_of(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 4)
    model = langid.fit(docs, bucket != 2)
    least = margin / max(1, len(model.languages))
    good = (F.col("lang_pred") != langid.UNDETERMINED) & ((F.col("score") >= least) | F.lit(len(model.languages) < 2))
    key = F.struct(id_key(F.col("doc_id")).alias("__id"), content_of(text_of(F.col("text"))).alias("__content")).alias("__key")
    kept = langid.predict(docs.select(key, "text"), model, id_col="__key").where(good).select("__key.*").distinct()
    keyed = as_rows(docs, __id=id_key(F.col("doc_id")), __content=content_of(text_of(F.col("text"))))
    return from_rows(keyed.join(kept, ["__id", "__content"], "left_semi"), docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that fail the base rules or that frequent lines of their source deplete; strikes these lines from the texts it keeps."""
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, A-Z and a-z alike, one row with the largest doc_id stays."""
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one with the smallest doc_id."""
    return minhash.drop_near_copies(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their place in a sequence."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language),
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("best_fit_packing", packed),
]

#: No SQL: language models, subword tokens and packing are beyond it; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each one's result written and read again; all that it made on the way, and its predecessor, are deleted then."""
    docs, mark = table(spark, sf_dir, "documents"), made()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        removed_since(spark, mark, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
