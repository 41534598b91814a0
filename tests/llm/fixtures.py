"""Small tables with every awkward case: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHING = (
    "id node label bucket words lines windows h n norm digest keep_id n_tokens ids bands class_id lang_pred score kept text_sha256 host content group "
    "__id __content __host __lines __places __row __key __node __salt __copy first hot cold salt pos line raw a.b"
).split()

WORDS = {
    "en": "the of and house with water from stone about winter morning people garden window silver market bridge letter".split(),
    "de": "der die und haus mit wasser aus stein über winter morgen leute garten fenster silber markt brücke brief schön".split(),
    "fr": "le la et maison avec eau depuis pierre sur hiver matin gens jardin fenêtre argent marché pont lettre été".split(),
}


def prose(lang, n, seed):
    r = random.Random(f"{lang}{seed}")
    return " ".join(r.choice(WORDS[lang]) + ("." if r.random() < 0.1 else "") for _ in range(n))


def edited(text, edits, seed):
    r, words = random.Random(seed), text.split()
    for i in r.sample(range(len(words)), edits):
        words[i] = f"x{r.randrange(10**6)}"
    return " ".join(words)


def rows():
    out = [(i, prose(lang, 60 + 3 * i, i), lang, f"s{i % 3}", 0) for i, lang in enumerate(["en", "de", "fr"] * 12)]
    base = prose("en", 200, "base")
    out += [(100, base, "en", "s0", 0), (101, base, "en", "s1", 0), (101, base, "en", "s1", 0), (102, base.upper(), "en", None, 0)]
    out += [(110 + k, edited(base, 3, k), "en", "s0", 0) for k in range(4)] + [(120, edited(base, 90, 9), "en", "s0", 0)]
    out += [(130, None, None, None, None), (131, "", "en", "s0", 0), (132, " \t\n ", None, "s0", 3), (133, "12 34 !!", "de", "s1", 8), (None, prose("de", 40, "n"), "de", "s1", 0)]
    out += [(None, None, None, None, None), (134, "ab" * 60000, "en", "s2", 0), (135, "one two three", "en", "s2", 0), (136, "one  two\tthree", "en", "s2", 0)]
    out += [(140, "stone water " * 400, "en", "s0", 0), (141, "a b c d e f g h i j k l m n o p q r s t u v w", "en", "s0", 0), (142, "É é ß I'm we'll 's ''ve  x\n\n y 2² ½", "fr", "s0", 0)]
    out += [(200 + k, f"Shared line of the site here\n{prose('en', 30, f's{k}')}", "en", "hot", 0) for k in range(25)]
    out += [(230, "Shared line of the site here\nfive words stand below it", "en", "hot", 0)]
    return out


def documents(spark, clashing=False):
    df = spark.createDataFrame(rows(), SCHEMA)
    return df.withColumns({c: F.lit("z") for c in CLASHING}) if clashing else df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def saved(spark, tmp_path, df, name="documents"):
    """df as the one table of a folder, in the way that queries read tables; the folder."""
    df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
