"""Spectra and identifications derived from the test tables, the same in every engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.constants import AMINO_ACIDS, CARBON_MASS_DELTA
from peakloom.functions.masses import sequence_mass
from peakloom.operators.joins import with_group

RESIDUES = list(AMINO_ACIDS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def psm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, cust, targets, predictions: token lists of 6 to 13 residues; every fifth prediction has one wrong residue."""
    names = F.array(*[F.lit(r) for r in RESIDUES])
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    at = lambda i: F.pmod(key * 7 + i * i * 3 + cust, F.lit(20)).cast("int")
    wrong = lambda i: F.when((key % 5 == 0) & (i == 3), F.pmod(at(i) + 1, F.lit(20)).cast("int")).otherwise(at(i))
    places = F.sequence(F.lit(1), (6 + key % 8).cast("int"))
    return table(spark, sf_dir, "orders").select(
        key.alias("id"), cust.alias("cust"),
        F.transform(places, lambda i: F.get(names, at(i))).alias("targets"), F.transform(places, lambda i: F.get(names, wrong(i))).alias("predictions"),
    )


def psm_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    """psm with empty predictions, a confidence, a charge, the theoretical and a disturbed precursor m/z."""
    key = F.col("id")
    base = psm(spark, sf_dir).withColumn("predictions", F.when(key % 11 == 0, F.array().cast("array<string>")).otherwise(F.col("predictions")))
    conf = F.round(F.lit(0.7) * ((key * 7919) % 1000) / 1000 + F.when(key % 5 == 0, 0.0).otherwise(0.3), 6)
    base = base.withColumn("confidence", conf).withColumn("charge", (1 + key % 4).cast("int"))
    base = base.withColumn("mz_theory", sequence_mass(F.col("targets"), F.col("charge")))
    mz = F.col("mz_theory") * (1 + ((key % 121) - 60) * 1e-6) + F.when(key % 9 == 0, F.lit(CARBON_MASS_DELTA) / F.col("charge")).otherwise(0.0)
    return base.withColumn("precursor_mz", mz)


def proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """protein_id and sequence: the target peptides of each customer, one after the other."""
    peptide = F.struct("id", F.array_join("targets", "").alias("text"))
    rows = psm(spark, sf_dir).groupBy("cust").agg(F.array_sort(F.collect_list(peptide)).alias("parts"))
    return rows.select(F.concat(F.lit("P"), F.col("cust").cast("string")).alias("protein_id"), F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("sequence"))


def group_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and group: the region of the order's customer; ids that 13 divides have none."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    found = orders.where(F.col("o_orderkey") % 13 != 0).join(places, F.col("o_custkey") == F.col("c_custkey"))
    return found.select(F.col("o_orderkey").alias("id"), F.col("r_name").alias("group"))


def psm_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_group(psm_x(spark, sf_dir), group_map(spark, sf_dir), "id")


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, precursor_mz, precursor_charge, mz_array, intensity_array of the orders with line items."""
    peak = F.struct(
        (-F.col("l_quantity")).alias("q"), F.col("l_extendedprice").alias("x"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"),
        (F.col("l_extendedprice") / 40).alias("mz"), (F.col("l_quantity") / 50).alias("intensity"),
    )
    peaks = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(peak)).alias("peaks"))
    rows = table(spark, sf_dir, "orders").join(peaks, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select(
        F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 200).alias("precursor_mz"), (1 + F.col("o_orderkey") % 4).cast("bigint").alias("precursor_charge"),
        F.transform("peaks", lambda p: p["mz"]).alias("mz_array"), F.transform("peaks", lambda p: p["intensity"]).alias("intensity_array"),
    )


def peptide_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and peptide: residues with modifications in several spellings, wrapping marks and stray characters."""
    key = F.col("id")
    tokens = F.transform(
        F.col("targets"),
        lambda t, i: F.when((t == "M") & (key % 3 == 0), "M[UNIMOD:35]").when((t == "C") & (key % 4 == 0), "C(+57.02)")
        .when((t == "N") & (key % 5 == 0), "N(+.98)").when((t == "S") & (key % 7 == 0), "S(p)").otherwise(t),
    )
    body = F.when(key % 17 == 0, F.array_join(tokens, ",")).otherwise(F.array_join(tokens, ""))
    head = F.when(key % 6 == 0, "[UNIMOD:1]-").when(key % 6 == 1, "(+42.01)").otherwise("")
    whole = F.concat(head, body)
    wrapped = F.when(key % 10 == 0, F.concat(F.lit("_"), whole, F.lit("_"))).when(key % 10 == 1, F.concat(F.lit("."), whole, F.lit("."))).otherwise(whole)
    return psm(spark, sf_dir).select("id", "targets", F.when(key % 19 == 0, F.lit(None)).otherwise(wrapped).alias("peptide"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, run, label of a scan, retention_time."""
    e = table(spark, sf_dir, "events")
    key = F.col("event_id")
    label = F.when(key % 3 == 0, key.cast("string")).when(key % 3 == 1, F.concat(F.lit("controller=0 scan="), key.cast("string"))).otherwise("none")
    return e.select("event_id", F.concat(F.lit("run_"), (F.col("user_id") % 5).cast("string")).alias("run"), label.alias("label"), F.col("value").alias("retention_time"))


def as_text(values: Column, digits: int = 6) -> Column:
    """A list of numbers as text of whole multiples of 10^-digits, for comparison across engines."""
    return F.array_join(F.transform(values, lambda v: F.round(v * 10**digits).cast("bigint").cast("string")), ",")


def ladders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, targets and a spectrum with every singly charged b and y ion of the target, for each customer.

    A search takes long for a row of few bytes, so that a split of the file would be too much for a task: the keys are
    dealt to four tasks for each core, however few splits there are.
    """
    from peakloom.constants import H2O_MASS, PROTON_MASS
    from peakloom.functions.masses import masses

    names = F.array(*[F.lit(r) for r in RESIDUES if r != "I"])
    key = F.col("c_custkey")
    places = F.sequence(F.lit(1), (6 + key % 5).cast("int"))
    keys = table(spark, sf_dir, "customer").select(key).repartition(4 * spark.sparkContext.defaultParallelism)
    df = keys.select(
        key.alias("id"), F.transform(places, lambda i: F.get(names, F.pmod(key * 7 + i * i * 3 + i * (key % 11), F.lit(19)).cast("int"))).alias("targets")
    )
    df = df.withColumn("m", masses(F.col("targets"))).withColumn("charge", (1 + F.col("id") % 3).cast("bigint"))
    sums = F.transform(F.sequence(F.lit(1), F.size("m") - 1), lambda k: F.aggregate(F.slice("m", 1, k), F.lit(0.0), lambda a, x: a + x))
    df = df.withColumn("b", sums).withColumn("whole", F.aggregate("m", F.lit(0.0), lambda a, x: a + x))
    ions = F.concat(F.transform("b", lambda x: x + PROTON_MASS), F.transform("b", lambda x: F.col("whole") - x + H2O_MASS + PROTON_MASS))
    return df.select(
        "id", "targets", ions.alias("mz_array"), F.transform(ions, lambda _: F.lit(1.0)).alias("intensity_array"),
        ((F.col("whole") + H2O_MASS) / F.col("charge") + PROTON_MASS).alias("precursor_mz"), F.col("charge").alias("precursor_charge"),
    )
