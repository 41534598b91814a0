"""Selection, permutations, buffers and scans against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from peakloom.operators import metrics, sampling, selection
from peakloom.operators.ordered import moving_average, numbered


@pytest.mark.parametrize("few", [0, 200, 50_000])
def test_at_ranks(spark, monkeypatch, few):
    """By passes to the last bit, and by the last values themselves."""
    monkeypatch.setattr(selection, "FEW", few)
    r = random.Random(1)
    values = [r.randrange(-(2**63), 2**63) for _ in range(500)] + [0, -1, 1, 2**63 - 1, -(2**63)] + [7] * 300 + [r.randrange(-5, 5) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(5)
    ranks = [1, 2, 250, 500, 501, 700, len(values)]
    want = {k: (sorted(values)[k - 1], sum(v < sorted(values)[k - 1] for v in values)) for k in ranks}
    assert selection.at_ranks(df, F.col("v"), ranks) == want
    with pytest.raises(ValueError, match="no rank"):
        selection.at_ranks(df, F.col("v"), [len(values) + 1])


def test_doubles_in_order(spark):
    values = [0.0, -0.0, 1.5, -1.5, math.inf, -math.inf, 5e-324, -5e-324, 1e300, math.nan, 0.1, 0.1]
    rows = spark.createDataFrame([(v,) for v in [*values, None]], "v double").select("v", selection.double_bits(F.col("v")).alias("b")).collect()
    known = sorted((r["b"], r["v"]) for r in rows if r["v"] is not None and not math.isnan(r["v"]))
    assert [v for _, v in known] == sorted(v for v in values if not math.isnan(v)) and all(selection.double_of(b) == v for b, v in known)
    assert max(rows, key=lambda r: -(2**64) if r["b"] is None else r["b"])["v"] != 1e300 and [r["b"] for r in rows if r["v"] is None] == [None]
    assert math.isnan(selection.double_of(max(r["b"] for r in rows if r["b"] is not None)))


@pytest.mark.parametrize("count", [0, 1, 40, 57, 300, 399, 400, 1000])
def test_smallest(spark, count):
    """Hashes that many rows share, null keys, and one row a hundred times."""
    r = random.Random(2)
    rows = [(r.choice([None, -3, 0, 5, 9]), r.choice([None, 1, 2, 3]), "x") for _ in range(300)] + [(0, 2, "same")] * 100
    df = spark.createDataFrame(rows, "a long, b long, c string").repartition(6)
    got = selection.smallest(df, [F.col("a"), F.col("b")], count).collect()
    key = lambda t: tuple((v is not None, v or 0) for v in t[:2])
    assert sorted(key(g) for g in got) == sorted(key(t) for t in rows)[:count]


def test_sample_is_the_same_however_rows_are_dealt(spark):
    df = spark.range(5000)
    take = lambda d: sorted(r[0] for r in sampling.sample_exact(d, 0.1, F.col("id")).collect())
    one = take(df.repartition(7))
    assert len(one) == 500 and one == take(df.coalesce(1)) and one != take(df.where("id < 4000"))
    assert sampling.sample_exact(df, 0.1, F.col("id"), 7)._jdf.queryExecution().toString().count("TakeOrdered") == 0


def test_thresholds(spark):
    r = random.Random(3)
    values = [r.choice([r.random(), 0.25, -0.0, 1.0]) for _ in range(333)]
    df = spark.createDataFrame([(v,) for v in [*values, None, None]], "confidence double").repartition(3)
    got = {r["k"]: r["threshold"] for r in metrics.thresholds(df, "confidence").collect()}
    assert got == {k: sorted(values)[-1 if k == 20 else 333 * k // 20] for k in range(21)}
    assert metrics.thresholds(df.where("confidence is null"), "confidence").count() == 0


@pytest.mark.parametrize("rows", [1, 2, 3, 5, 16, 17, 1000])
def test_permutation(spark, rows):
    places = [r[0] for r in spark.range(rows).select(sampling.permuted(F.col("id"), rows, 7)).collect()]
    assert sorted(places) == list(range(rows)) and (rows < 16 or places != sorted(places))
    assert rows < 1000 or abs(sum(i * p for i, p in enumerate(places)) / sum(i * i for i in range(rows)) - 0.75) < 0.05  # as without any order


def test_shards_keep_their_sizes(spark):
    df = spark.range(1000, numPartitions=6).withColumn("x", F.col("id") * 2)
    rows = sampling.shuffled(df, [10, 0, 500, 490], seed=3).collect()
    assert {(r["shard"], r["place"]) for r in rows} == {(s, p) for s, n in enumerate([10, 0, 500, 490]) for p in range(n)}
    assert sorted(r["id"] for r in rows) == list(range(1000)) and all(r["x"] == 2 * r["id"] for r in rows)
    again = sampling.shuffled(df, [10, 0, 500, 490], seed=3).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again)) != sorted(map(tuple, sampling.shuffled(df, [10, 0, 500, 490], seed=4).collect()))
    with pytest.raises(Exception, match="999 rows in all"):
        sampling.shuffled(df, [999]).collect()
    parts = sampling.shuffle_shards(df, 3).rdd.glom().map(len).collect()
    assert sorted(n for n in parts if n) in ([333, 333, 334], [334, 666], [333, 667], [1000])


def by_hand(values, size, seed, part):
    draw, held, out = random.Random(f"{seed}/{part}"), [], []
    for v in values:
        if len(held) < size:
            held.append(v)
        else:
            j = draw.randrange(size)
            out.append(held[j])
            held[j] = v
    draw.shuffle(held)
    return out + held


@pytest.mark.parametrize("size", [1, 7, 100, 5000])
def test_buffer_is_the_plain_one(spark, size):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        df = spark.range(1000, numPartitions=3).withColumn("s", F.col("id").cast("string"))
        want = [by_hand(p, size, 5, k) for k, p in enumerate(df.select("id").rdd.map(lambda r: r[0]).glom().collect())]
        got = sampling.buffered(df, size, 5).rdd.map(lambda r: (r["id"], r["s"])).glom().collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [[(v, str(v)) for v in p] for p in want]
    assert sampling.buffered(df.limit(0), size).count() == 0


def test_buffer_on_a_stream(spark, tmp_path):
    spark.range(500).write.parquet(f"{tmp_path}/in")
    stream = sampling.buffered(spark.readStream.schema("id long").parquet(f"{tmp_path}/in"), 50)
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination(120)
    assert sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(500))


def test_numbers_follow_partitions(spark):
    df = spark.range(1000, numPartitions=7).where("id < 100 or id > 600")
    rows = sorted(map(tuple, numbered(df).collect()))
    assert [n for _, n in rows] == list(range(499))


def test_moving_average(spark):
    r = random.Random(4)
    values = [(k, r.uniform(-5, 5)) for k in range(700)]
    got = {x["id"]: x["average"] for x in moving_average(spark.createDataFrame(values, "id long, v double").repartition(5), [F.col("id")], "v", 0.9).collect()}
    average = values[0][1]
    for k, v in values:
        average = 0.9 * average + 0.1 * v if k else v
        assert got[k] == pytest.approx(average, abs=1e-12)
    assert moving_average(spark.createDataFrame([], "id long, v double"), [F.col("id")], "v").count() == 0
    for bad in (math.nan, math.inf, None):
        with pytest.raises(Exception, match="invalid value"):
            moving_average(spark.createDataFrame([(1, 1.0), (2, bad)], "id long, v double"), [F.col("id")], "v")
