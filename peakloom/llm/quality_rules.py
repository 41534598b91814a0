"""Quality rules in DataFrame functions alone: per-text counts and cross-document line frequency.

A line that many different texts of one host carry is page furniture. Lines are
normalised and hashed, the distinct texts behind each (host, line) are counted
(exact copies of a text count once), lines above the limit are struck from every
text but the first that carries them, and texts left with too little are rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.llm.shared import SPACE_CLASS, as_rows, content_of, from_rows, id_key, text_of, words_of
from peakloom.operators.joins import spread_join
from peakloom.storage import written

#: Characters that count as symbols.
SYMBOLS = r"#*$%&|<>"

#: Words in a window.
WINDOW = 8


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), then the columns of carry.

    n_repeat_words counts the words inside an 8-word window that the text holds at least twice, first included.
    Windows are compared by a 64-bit hash of their word hashes. One hash-set pass shows which texts repeat a
    window at all; only those sort their windows.
    """
    lines = F.filter(F.split("text", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    last = F.size("hashes") - WINDOW
    found = docs.select(F.col(id_col).alias("id"), *carry, text_of(F.col(text_col)).alias("text"))
    found = found.withColumn("words", words_of(F.col("text"))).withColumn("lines", lines)
    found = found.select(
        "id",
        *carry,
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    window = lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(WINDOW)])
    found = found.withColumn("windows", F.when(last > 0, F.transform(F.sequence(F.lit(0), last), window)))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    found = found.withColumn("ordered", F.when(repeats, F.array_sort(placed))).drop("hashes", "windows")
    near = lambda x, k: F.get("ordered", k)["h"] == x["h"]
    twice = F.filter("ordered", lambda x, k: near(x, k - 1) | near(x, k + 1))
    found = found.withColumn("places", F.array_sort(F.transform(twice, lambda x: x["i"]))).drop("ordered")
    covered = F.aggregate(
        "places",
        F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).alias("n")),
        lambda acc, p: F.struct(p.alias("at"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["at"])).alias("n")),
        lambda acc: acc["n"],
    )
    return found.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), *carry,
    )


def _lines(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """id, host, content (hash of the text), pos, line (hash of the normalised line), n (words), for lines with a word."""
    line = F.lower(F.trim(F.regexp_replace("raw", SPACE_CLASS + "+", " ")))
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(host_col).alias("host"), content_of(text_of(F.col(text_col))).alias("content"),
        F.posexplode(F.split(text_of(F.col(text_col)), "\n")).alias("pos", "raw"),
    )
    rows = rows.select("id", "host", "content", "pos", line.alias("line")).where("line <> ''")
    words = F.char_length("line") - F.char_length(F.regexp_replace("line", " ", "")) + 1
    return rows.select("id", "host", "content", "pos", F.xxhash64("line").alias("line"), words.alias("n"))


def frequent_lines(lines: DataFrame, max_texts: int) -> DataFrame:
    """host, line and first (id and content of the text that keeps the line) of the lines that more than max_texts distinct texts of the host carry.

    The first text is that with the smallest id, nulls last, and among those with one id that with the smallest content hash.
    """
    carrier = F.struct(F.col("id").isNull().alias("no_id"), "id", "content")
    by_text = lines.groupBy("host", "line", "content").agg(F.min(carrier).alias("first"))
    return (
        by_text.groupBy("host", "line")
        .agg(F.count(F.lit(1)).alias("texts"), F.min("first").alias("first"))
        .where(F.col("texts") > max_texts)
        .select("host", "line", "first")
    )


def _struck_lines(docs: DataFrame, id_col: str, text_col: str, host_col: str, max_texts: int) -> DataFrame:
    """id, host, content, pos, n of the lines to strike: the frequent ones, except from the first text that carries them."""
    lines = _lines(docs, id_col, text_col, host_col)
    frequent = written(frequent_lines(lines, max_texts), "frequent-lines")
    hit = spread_join(lines, frequent, {"host": "host", "line": "line"}, F.col("content"))  # a frequent line is a hot key
    first = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("content") == F.col("first.content"))
    return hit.where(~first).select("id", "host", "content", "pos", "n")


def _keyed(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    content = content_of(text_of(F.col(text_col)))
    return as_rows(docs, __id=id_key(F.col(id_col)), __host=id_key(F.col(host_col)), __content=content)


def _without(docs: DataFrame, hit: DataFrame, id_col: str, text_col: str, host_col: str, keyed: DataFrame | None = None) -> DataFrame:
    """docs with each text rebuilt, in line order, without the lines of hit (id, host, content, pos); keyed: docs by _keyed(), if not all of them."""
    hit = hit.select(id_key(F.col("id")).alias("__id"), id_key(F.col("host")).alias("__host"), F.col("content").alias("__content"), "pos")
    places = hit.groupBy("__id", "__host", "__content").agg(F.collect_set("pos").alias("__places"))  # a text's lines at most
    keyed = _keyed(docs, id_col, text_col, host_col) if keyed is None else keyed
    text = F.col("__row").getField(text_col)
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__places"))
    rebuilt = F.array_join(F.transform(left, lambda p: F.get(F.col("__lines"), p)), "\n")
    joined = keyed.join(places, ["__id", "__host", "__content"], "left").withColumn("__lines", F.split(text, "\n"))
    return from_rows(joined, docs, **{text_col: F.when(F.col("__places").isNull(), text).otherwise(rebuilt)})


def struck_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_texts: int = 20) -> DataFrame:
    """docs with each text rebuilt, in line order, without its struck lines; texts without one and other columns as they were."""
    return _without(docs, _struck_lines(docs, id_col, text_col, host_col, max_texts), id_col, text_col, host_col)


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_texts: int = 20,
    min_words: int = 20,
    min_left: float = 0.2,
    max_repeat_percent: int = 30,
) -> DataFrame:
    """Per row of docs: id, the base counts, n_struck_words, base_failed, kept.

    base_failed: fewer than min_words words, or more than max_repeat_percent of them in repeated windows.
    A text is depleted when striking the frequent lines of its host leaves less than min_left of its words; kept is
    false for base failures and depleted texts. The text with the smallest id keeps
    its frequent lines, so that no passage vanishes altogether; null ids come last, and of several texts with that id,
    or none, the one with the smallest content hash counts as first. A null or empty text has no words and fails; a
    null host is a host of its own; rows that repeat (same id, host and text) share one verdict.
    """
    return _judged(docs, id_col, text_col, host_col, max_texts, min_words, min_left, max_repeat_percent).drop("__host", "__content")


def _judged(
    docs: DataFrame, id_col: str, text_col: str = "text", host_col: str = "source",
    max_texts: int = 20, min_words: int = 20, min_left: float = 0.2, max_repeat_percent: int = 30, hit: DataFrame | None = None,
) -> DataFrame:
    """judge() with the other parts of a row's key, __host and __content (hash of the text)."""
    key = ("id", "host", "content")
    hit = _struck_lines(docs, id_col, text_col, host_col, max_texts) if hit is None else hit
    struck = hit.groupBy(*key, "pos").agg(F.max("n").alias("n")).groupBy(*key).agg(F.sum("n").alias("n_struck"))
    base = base_counts(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(host_col).alias("host"),
                    content_of(text_of(F.col(text_col))).alias("content")),
        "id", "text", ("host", "content"),
    )
    out = base.alias("b").join(struck.alias("s"), F.expr("b.id <=> s.id and b.host <=> s.host and b.content = s.content"), "left")
    gone = F.coalesce(F.col("n_struck"), F.lit(0))
    left = F.col("n_words") - gone
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    depleted = (gone > 0) & (left < min_left * F.col("n_words"))
    return out.select(
        F.col("b.id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        gone.cast("long").alias("n_struck_words"), failed.alias("base_failed"), (~failed & ~depleted).alias("kept"),
        F.col("b.host").alias("__host"), F.col("b.content").alias("__content"),
    )


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", strike: bool = True, **limits) -> DataFrame:
    """docs without the rows that judge() rejects, each by its own id, host and text, and without the lines that it strikes.

    Texts that stay are rebuilt in line order; those without a struck line and all other columns are as they were, and
    with strike false all texts are.
    """
    hit = written(_struck_lines(docs, id_col, text_col, host_col, limits.get("max_texts", 20)), "struck-lines")
    bad = _judged(docs, id_col, text_col, host_col, hit=hit, **limits).where("not kept")
    bad = bad.select(id_key(F.col(id_col)).alias("__id"), id_key(F.col("__host")).alias("__host"), "__content").distinct()
    good = _keyed(docs, id_col, text_col, host_col).join(bad, ["__id", "__host", "__content"], "left_anti")
    return _without(docs, hit, id_col, text_col, host_col, good) if strike else from_rows(good, docs)
