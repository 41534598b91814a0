"""Published values of single operators over a toy alphabet."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.functions import masses, numeric, peaks, tokens
from peakloom.operators import filters, knapsack, metrics, schema

TOY = {"A": 10.5, "B": 20.75, "C": 15.68, "D": 18.25, "E": 12.33}
VOCAB = tokens.vocabulary(TOY)


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def listed(text):
    return F.array(*[F.lit(c) for c in text]).cast("array<string>")


def test_tokenizer(spark):
    cases = {
        "ABC": ["A", "B", "C"], "M(ox)AC": ["M(ox)", "A", "C"], "[UNIMOD:1]-AM[UNIMOD:35]": ["[UNIMOD:1]", "A", "M[UNIMOD:35]"],
        "A+15.99B-17.02": ["A+15.99", "B-17.02"], "N.98K": ["N.98", "K"], "(+42.01)AC": ["(+42.01)", "A", "C"], "A, B": ["A", "B"], "": [],
    }
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r["p"]: r["t"] for r in df.select("p", tokens.tokenize(F.col("p")).alias("t")).collect()} == cases
    assert one(spark, tokens.tokenize(F.lit(None).cast("string")))[0] == []


def test_masses(spark):
    seq = listed("BACDA")
    r = one(spark, *[masses.sequence_mass(seq, z, TOY) for z in (None, F.lit(1), F.lit(2), F.lit(0))])
    assert r[0] == pytest.approx(93.6906) and r[1] == pytest.approx(94.697876) and r[2] == pytest.approx(47.852576) and r[3] == pytest.approx(93.6906)
    r = one(spark, masses.ppm_error(F.lit(120.0), F.lit(109.0), F.lit(3)), masses.ppm_error(F.lit(120.0), F.lit(109.0), F.lit(0)))
    assert r[0] == pytest.approx(100917.43119266056) and r[1] is None
    theory = masses.sequence_mass(listed("A"), F.lit(1), TOY)
    r = one(spark, masses.ppm_errors(theory, F.lit(5500.0), F.lit(1)), masses.matches_precursor(theory, F.lit(5500.0), F.lit(1)))
    assert r[0] == pytest.approx([-994633.1134545455, -994450.6861818183]) and r[1] is False
    theory = masses.sequence_mass(listed("IAHYNKR"), F.lit(2))
    assert one(spark, masses.delta_mass_ppm(theory, F.lit(451.25348), F.lit(2)))[0] == pytest.approx(0.6781111138830191, abs=1e-6)
    assert one(spark, masses.scaled(F.lit(2.5), 1))[0] == 2


def test_unknown_residue_stops(spark):
    with pytest.raises(Exception, match="unknown residue"):
        one(spark, masses.sequence_mass(listed("AZ"), None, TOY))


def test_encoding(spark):
    seq = listed("BACDE")
    r = one(
        spark, tokens.encode(seq, VOCAB), tokens.encode(seq, VOCAB, True, 7), tokens.encode_target(listed("ABCDEAAABC"), VOCAB),
        tokens.decode(F.array(*map(F.lit, [4, 3, 5, 6, 7, 2, 0])), VOCAB), tokens.decode(F.array(*map(F.lit, [4, 3, 5, 6, 7, 2, 0])), VOCAB, True),
    )
    assert r[0] == [4, 3, 5, 6, 7] and r[1] == [4, 3, 5, 6, 7, 2, 0] and r[2] == [5, 4, 3, 3, 3, 7, 6, 5, 4, 3, 2]
    assert r[3] == list("BACDE") and r[4] == list("EDCAB")
    r = one(spark, tokens.sanitise(F.lit("_ABC_")), tokens.sanitise(F.lit(".ABC.")), tokens.to_proforma(F.array(F.lit("[UNIMOD:1]"), F.lit("A"))), tokens.accession(F.lit("x")))
    assert list(r) == ["ABC", "ABC", "[UNIMOD:1]-A", None]


def test_peaks(spark):
    mz = F.array(*map(F.lit, [10.0, 20.0, 25.0, 30.0, 51.25, 66.6]))
    ones = F.array(*[F.lit(1.0)] * 6)
    got = one(spark, peaks.processed(mz, ones, F.lit(500.0), 50.0, 2500.0, 2.0, 0.01, 4), peaks.processed(mz, ones, F.lit(500.0), 1000.0))
    assert [(p["mz"], round(p["intensity"], 4)) for p in got[0]] == [(51.25, 0.7071), (66.6, 0.7071)]
    assert [tuple(p) for p in got[1]] == [(0.0, 1.0)]


def test_matching(spark):
    rows = [(1, list("ABAB"), list("ABEB"), 0.9), (2, list("ABCDE"), list("ACCDE"), 0.8), (3, list("ABC"), [], 0.1), (4, [], list("A"), None)]
    df = spark.createDataFrame(rows, "id int, targets array<string>, predictions array<string>, confidence double")
    got = {r["id"]: r for r in metrics.matches(df, table=TOY).collect()}
    assert got[1]["n_match"] == 2 and got[2]["n_match"] == 1 and got[3]["n_match"] == 0 and got[4]["n_match"] == 0
    single = metrics.precision_recall(metrics.matches(df.where("id = 2"), table=TOY)).first()
    assert [single[c] for c in ("aa_prec", "aa_recall", "pep_recall", "pep_prec")] == [0.2, 0.2, 0.0, 0.0]
    none = metrics.precision_recall(metrics.matches(df.where("id = 3"), table=TOY)).first()
    assert none["aa_prec"] == 1.0 and none["pep_prec"] == 1.0 and none["pep_recall"] == 0.0
    assert metrics.precision_recall(metrics.matches(df.where("id = 0"), table=TOY)).first()["pep_recall"] is None
    assert tuple(metrics.recall_at_fdr(metrics.matches(df.where("id < 4"), table=TOY)).first()) == (0, 0.0, 1.0)


def test_knapsack():
    chart = knapsack.build(TOY, 4000.0, 10000, 2)
    assert len(chart.masses) == 1154257
    found = chart.feasible(46.76, 1.0)
    assert len(found) == 13 and found[0] == 458367 and found[-1] == 476667


def test_knapsack_by_enumeration(tmp_path, spark):
    table = {"A": 3.0, "B": 5.0, "n": -1.0}
    chart = knapsack.build(table, 20.0, 1, 0)
    seen = {m + s for m in (3, 5) for s in (0, -1)}
    while (more := {a + b for a in seen for b in (3, 5) if a + b <= 20} - seen):
        seen |= more
    assert set(chart.masses.tolist()) == seen
    knapsack.save(spark, chart, f"{tmp_path}/k")
    assert np.array_equal(knapsack.load(spark, f"{tmp_path}/k").reach, chart.reach)
    with pytest.raises(Exception, match="already exists"):
        knapsack.save(spark, chart, f"{tmp_path}/k")


def test_numeric(spark):
    vectors = F.array(*[F.array(*map(F.lit, v)) for v in ([1.0, 0.0], [3.0, -2.0], [9.0, 9.0])])
    mask = F.array(F.lit(False), F.lit(False), F.lit(True))
    r = one(spark, *[numeric.pooled(vectors, mask, h) for h in ("mean", "max", "sum")], numeric.log_add_exp(F.lit(0.0), F.lit(0.0)), numeric.warmup_factor(F.lit(5), 10))
    assert r[0] == [2.0, -1.0] and r[1] == [3.0, -2.0] and r[2] == [4.0, -2.0] and r[3] == pytest.approx(np.log(2)) and r[4] == 0.5
    with pytest.raises(ValueError):
        numeric.pooled(vectors, mask, "full")


def test_checks(spark):
    df = spark.createDataFrame([(1.0, 2)], "precursor_mz double, precursor_charge int")
    with pytest.raises(ValueError, match="Missing column.*mz_array, intensity_array"):
        schema.check_columns(df)
    assert filters.values_within(df, "precursor_mz", 0, 2) and not filters.values_within(df, "precursor_mz", None, 0)
    with pytest.raises(ValueError):
        filters.require_precursor_matches(df, F.lit(False))
    assert schema.flattened({"a": {"b": 1, "c": {"d": 2}}, "e": 3}) == {"a.b": 1, "a.c.d": 2, "e": 3}
