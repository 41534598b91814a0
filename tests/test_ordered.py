"""Global ranks, running sums and metrics against plain Python."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from peakloom import storage
from peakloom.functions import masses
from peakloom.operators import metrics
from peakloom.operators.ordered import running
from peakloom.plans import spectral


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_running_does_not_depend_on_exchange_reuse(spark, reuse):
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        df = spark.range(200_000, numPartitions=7).select("id", (F.xxhash64("id") % 1000).alias("v"))
        rows = running(df, [F.col("v").desc(), F.col("id")], {"total": F.col("id")}).toPandas().sort_values("rank")
    finally:
        spark.conf.set("spark.sql.exchange.reuse", "true")
    assert (rows["rank"].to_numpy() == np.arange(1, 200_001)).all()
    ordered = rows.sort_values(["v", "id"], ascending=[False, True])
    assert (ordered["rank"].to_numpy() == rows["rank"].to_numpy()).all() and (rows["total"].to_numpy() == rows["id"].cumsum().to_numpy()).all()


def test_running_by_group(spark):
    rows = [(k, None if k % 4 == 3 else f"g{k % 4}", k * 37 % 101) for k in range(500)]
    got = running(spark.createDataFrame(rows, "id long, g string, v long"), [F.col("v"), F.col("id")], {"total": F.col("v")}, by="g").collect()
    for group in {r[1] for r in rows}:
        inside = sorted((r for r in rows if r[1] == group), key=lambda r: (r[2], r[0]))
        want = [(r[0], k + 1, sum(x[2] for x in inside[: k + 1])) for k, r in enumerate(inside)]
        assert sorted(((r["id"], r["rank"], r["total"]) for r in got if r["g"] == group), key=lambda r: r[1]) == want
    assert running(spark.createDataFrame([], "id long"), [F.col("id")]).count() == 0


def walked_by_hand(t, p):
    i = j = n = 0
    while i < len(t) and j < len(p):
        a, b = sum(t[: i + 1]), sum(p[: j + 1])
        if abs(a - b) < 0.5:
            n, i, j = n + (abs(t[i] - p[j]) < 0.1), i + 1, j + 1
        elif b > a:
            i += 1
        else:
            j += 1
    return n


def test_walk_like_by_hand():
    rng = np.random.default_rng(3)
    pairs = [([], [1.0]), ([1.0], []), (None, [2.0]), ([57.02], [57.02])]
    pairs += [(rng.choice([57.02, 71.04, 87.03, 114.04], rng.integers(1, 9)).tolist(), rng.choice([57.02, 71.04, 87.03, 114.04, 57.1], rng.integers(1, 9)).tolist()) for _ in range(300)]
    for lo, hi in ((0, len(pairs)), (5, 200)):
        t, p = (pa.array([x[k] for x in pairs], pa.list_(pa.float64())).slice(lo, hi - lo) for k in (0, 1))
        assert metrics.walked(t, p, 0.5, 0.1).tolist() == [walked_by_hand(a or [], b or []) for a, b in pairs[lo:hi]]


def test_error_rate_tells_unknown_tokens_apart(spark):
    rows = [(["A", "X1", "C"], ["A", "Y2", "C"]), (["I", "K"], ["L", "K"]), (["A"], []), (["Q"], None)]
    got = metrics.aa_error_rate(spark.createDataFrame(rows, "t array<string>, p array<string>"), "t", "p").first()
    assert (got["n_edits"], got["n_ref"]) == (3, 7)


def test_curve_is_strict(spark):
    rows = [(k, c, m) for k, (c, m) in enumerate([(0.0, 1), (1.0, 1), (0.5, 0), (33 / 99, 1), (0.7, 1), (None, 1), (1 / 99, 0)])]
    got = metrics.strict_curve(spark.createDataFrame(rows, "id long, confidence double, pep_match int")).collect()
    assert len(got) == 100
    for r in got:
        known = [x for x in rows if x[1] is not None]
        tp, fp = (sum(c > r["threshold"] and m == hit for _, c, m in known) for hit in (1, 0))
        assert (r["tp"], r["fp"], r["fn"]) == (tp, fp, 4 - tp), r
        assert r["precision"] == (tp / (tp + fp) if tp + fp else None)


def test_no_local_folder_on_a_cluster():
    class Session:
        def __init__(self, master, where):
            self.sparkContext = type("Context", (), {"master": master})()
            self.conf = type("Conf", (), {"get": lambda _, key, default: where})()

    assert storage.shared_dir(Session("yarn", "hdfs:/shared/")) == "hdfs:/shared" and storage.shared_dir(Session("local[2]", None)).startswith("file:")
    with pytest.raises(ValueError, match="share"):
        storage.shared_dir(Session("yarn", None))


def test_running_sums_in_rows(spark, sf):
    """Sums within a list ignore nulls as a window's sum does, and cumulative_mass neither shuffles nor sorts."""
    rows = spark.createDataFrame([([0.1, 0.2, 0.3],), ([None, 1.5, None, 2.0],), ([],), (None,)], "v array<double>")
    assert [r[0] for r in rows.select(masses.running(F.col("v"))).collect()] == [[0.1, 0.1 + 0.2, 0.1 + 0.2 + 0.3], [None, 1.5, 1.5, 3.5], [], None]
    plan = spectral.cumulative_mass(spark, sf)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan
