"""Searches meet the mass they are given, and agree where they must."""

import itertools

import numpy as np

from peakloom.constants import AMINO_ACIDS, H2O_MASS, PROTON_MASS
from peakloom.operators import decode, knapsack
from peakloom.plans import catalogue, derive

TABLE = {a: m for a, m in AMINO_ACIDS.items() if a != "I"}


def test_searches(spark, sf):
    spectra = derive.ladders(spark, sf)
    chart = knapsack.build(TABLE, 2400.0, 1000, 1)
    scorer = decode.FragmentEvidence(tuple(TABLE.values()))
    want = {r["id"]: r for r in spectra.collect()}
    right = {}
    for name, search in (("greedy", decode.choose(1, table=TABLE)), ("beam", decode.choose(5, table=TABLE)), ("knapsack", decode.choose(5, chart, table=TABLE))):
        rows = decode.decode(spectra, search, scorer).collect()
        assert {r["id"] for r in rows} == set(want)
        for r in rows:
            assert len(r["token_log_probs"]) == len(r["predictions"])
            if r["meets_precursor"]:
                w = want[r["id"]]
                mass = sum(TABLE[t] for t in r["predictions"]) + H2O_MASS
                whole = (w["precursor_mz"] - PROTON_MASS) * w["precursor_charge"]
                assert min(abs(whole - mass - 1.00335 * k) for k in (0, 1)) < 5e-5 * whole + 1e-6
        right[name] = np.mean([r["predictions"] == want[r["id"]]["targets"] for r in rows])
    assert right["knapsack"] >= right["beam"] >= right["greedy"] > 0 and right["knapsack"] > 0.5


def test_terminal_residue_only_completes():
    table = {"A": 71.037114, "[UNIMOD:1]": 42.010565}
    search = decode.choose(1, table=table)
    assert not search.open_residues(71.037114 + 42.010565, 0.01)[1]
    assert search.open_residues(42.010565, 0.01)[1]


def test_given_sequences_score(spark, sf):
    spectra = derive.ladders(spark, sf)
    scorer = decode.FragmentEvidence(tuple(TABLE.values()))
    given = {r["id"]: r["log_prob"] for r in decode.score_sequences(spectra, "targets", scorer, TABLE).collect()}
    found = {r["id"]: r for r in decode.decode(spectra, decode.choose(1, table=TABLE), scorer).collect()}
    targets = {r["id"]: r["targets"] for r in spectra.collect()}
    same = [k for k, r in found.items() if r["predictions"] == targets[k] and r["meets_precursor"]]
    assert same and all(abs(found[k]["log_prob"] - given[k]) < 1e-9 for k in same)


def test_every_order_has_its_masses(spark, tmp_path):
    prices = {k: 100 + (k * 37 % 101) * 0.83 + k / 100 for k in range(1, 60)}
    spark.createDataFrame(list(prices.items()), "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    masses = {round(p * 100) for p in prices.values()}
    want = {}
    for k, p in prices.items():
        hit = [m for m in masses if round((p - 3) * 100) < m < round((p + 3) * 100)]
        want[k] = (len(hit), min(hit), max(hit))
    got = {r["id"]: (r["n"], r["low"], r["high"]) for r in catalogue.queries()["feasible_masses_all"](spark, str(tmp_path)).collect()}
    assert got == want and len(got) == 59


def test_wide_beam_like_enumeration():
    """A beam as wide as the tree finds what an enumeration of all sequences finds, in its order, with a knapsack or without."""
    table = {"A": 71.037114, "G": 57.021464, "S": 87.032028}
    masses = tuple(table.values())
    scorer = decode.FragmentEvidence(masses)
    rng = np.random.default_rng(2)
    truth = [1, 0, 2, 0, 1]
    whole = sum(masses[i] for i in truth) + H2O_MASS
    mz, intensity = rng.uniform(50, whole, 30), rng.uniform(0, 1, 30)
    state = scorer.start([(mz, intensity)], np.array([whole]))
    allowed, want = 5e-5 * whole, []
    for n in range(1, 8):
        for seq in itertools.product(range(3), repeat=n):
            left = whole - H2O_MASS - sum(masses[i] for i in seq)
            if min(abs(left - 1.00335 * k) for k in (0, 1)) < allowed:
                score = lambda k, seq=seq: scorer.score(state, np.array([0]), np.array([seq[:k]], int).reshape(1, k))[0]
                want.append((sum(score(k)[t] for k, t in enumerate(seq)) + score(n)[-1], seq))
    want.sort(key=lambda x: -x[0])
    for chart in (None, knapsack.build(table, 700.0, 100_000, 1)):  # so fine that rounding decides no case here
        got = decode.choose(5000, chart, table=table).run(scorer, mz, intensity, whole)
        assert [b.tokens for b in got if b.met] == [seq for _, seq in want]
        assert np.allclose([b.log_prob for b in got if b.met], [x for x, _ in want])


def test_evidence_by_hand():
    """The scorer's log-probabilities from its definition, one spectrum at a time and in a block."""
    masses = tuple(TABLE.values())
    scorer = decode.FragmentEvidence(masses)
    rng = np.random.default_rng(4)
    spectra = [(rng.uniform(50, 900, n), rng.uniform(0, 1, n)) for n in (25, 0, 3)]
    whole = np.array([900.0, 700.0, 800.0])
    together = scorer.score(scorer.start(spectra, whole), np.array([2, 0, 1, 0]), np.array([[3, 1], [0, 5], [2, 2], [7, 7]]))
    for row, (k, prefix) in zip(together, [(2, (3, 1)), (0, (0, 5)), (1, (2, 2)), (0, (7, 7))], strict=True):
        mz, intensity = spectra[k]
        logits = []
        for m in masses:
            suffix = sum(masses[i] for i in prefix) + m
            ions = (suffix + H2O_MASS + PROTON_MASS, whole[k] - H2O_MASS - suffix + PROTON_MASS)
            found = sum(intensity[np.abs(mz - ion) <= 0.02].sum() for ion in ions)
            logits.append(8.0 * min(found / (intensity.max() if len(intensity) else 1.0), 2.0))
        logits = np.array([*logits, 0.0])
        assert np.allclose(row, logits - np.log(np.exp(logits).sum()))


def test_decoders_give_the_same_as_one_spectrum_at_a_time(spark, sf):
    spectra = derive.ladders(spark, sf).limit(40)
    scorer = decode.FragmentEvidence(tuple(TABLE.values()))
    search = decode.choose(5, knapsack.build(TABLE, 2400.0, 1000, 1), table=TABLE)
    got = {}
    for r in decode.decode(spectra, search, scorer, best_only=False).collect():
        got.setdefault(r["id"], []).append((r["rank"], tuple(r["predictions"]), round(r["log_prob"], 9), r["meets_precursor"]))
    for r in spectra.collect():
        mass = (r["precursor_mz"] - PROTON_MASS) * r["precursor_charge"]
        beams = search.run(scorer, np.array(r["mz_array"]), np.array(r["intensity_array"]), mass)
        want = [(k, tuple(search.names[i] for i in reversed(b.tokens)), round(b.log_prob, 9), b.met) for k, b in enumerate(beams)]
        assert sorted(got[r["id"]]) == want


def test_shuffles_keep_all_rows(spark, sf):
    from peakloom.operators import sampling

    df = spark.range(1000)
    for rows in (sampling.shuffle_rows(df), sampling.shuffle_shards(df, 4)):
        ids = [r[0] for r in rows.collect()]
        assert sorted(ids) == list(range(1000)) and ids != sorted(ids)
    assert catalogue.queries()["shuffle"](spark, sf).count() > 0


def test_search_is_dealt_to_tasks(spark, sf):
    """One small file of customers is searched by several tasks, all with rows."""
    counts = derive.ladders(spark, sf).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(counts) == 4 * spark.sparkContext.defaultParallelism and min(counts) > 0
