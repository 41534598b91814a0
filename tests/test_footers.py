"""Shards that are full, schemas that differ, rows by index, and edit distances."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from peakloom.operators import filters, metrics, sampling
from peakloom.sources import footers, loader, ranges, sinks


@pytest.mark.parametrize(("rows", "parts", "most"), [(1000, 7, 100), (1001, 7, 100), (999, 3, 1000), (5, 9, 2), (0, 3, 10)])
def test_shards_are_full(spark, tmp_path, rows, parts, most):
    """What one partition leaves over fills the next one's shard; rows keep their order through the files."""
    df = spark.range(rows, numPartitions=parts).select(F.col("id"), (F.col("id") * 2).alias("x"))
    names = sinks.write_sharded(df, str(tmp_path), "set", "train", most)
    count = max(1, -(-rows // most))
    assert names == [f"dataset-set-train-{i:04d}-{count:04d}.parquet" for i in range(count)]
    files = [pq.read_table(tmp_path / n) for n in names]
    assert [f.num_rows for f in files] == ([most] * (rows // most) + [rows % most] * (rows % most > 0) or [0])
    assert [i for f in files for i in f["id"].to_pylist()] == list(range(rows)) and files[0].column_names == ["id", "x"]


def test_first_seen_type_wins(spark, tmp_path):
    """int, bigint and text of one column load in the type of the first file that has it, in the order of the files."""
    def put(name, **columns):
        pq.write_table(pa.table(columns), tmp_path / name)

    put("a.parquet", scan_number=pa.array([1, 2], pa.int32()), note=["a", "b"])
    put("b.parquet", scan_number=pa.array([3], pa.int64()), value=pa.array([0.5], pa.float64()))
    put("c.parquet", value=pa.array(["7.5"]), scan_number=pa.array([4], pa.int16()), note=[None], **{"odd.name": [1]})
    put("d.parquet", scan_number=pa.array([5], pa.int32()), note=["e"])
    df = footers.unified(spark, ranges.listed(spark, str(tmp_path)))
    assert df.dtypes == [("scan_number", "int"), ("note", "string"), ("value", "double"), ("odd.name", "bigint")]
    assert sorted(map(tuple, df.collect())) == [(1, "a", None, None), (2, "b", None, None), (3, None, 0.5, None), (4, None, 7.5, 1), (5, "e", None, None)]
    assert dict(footers.unified(spark, ranges.listed(spark, [f"{tmp_path}/c.parquet", f"{tmp_path}/a.parquet"])).dtypes)["scan_number"] == "smallint"
    pq.write_table(pa.table({"precursor_charge": pa.array([2], pa.int32()), "precursor_mz": [1.0]}), tmp_path / "e.parquet")
    pq.write_table(pa.table({"precursor_charge": pa.array([3], pa.int64()), "precursor_mz": [2.0]}), tmp_path / "f.parquet")
    assert sorted(r["precursor_charge"] for r in loader.read_parquet(spark, [f"{tmp_path}/{x}.parquet" for x in "ef"]).collect()) == [2, 3]
    put("g.parquet", value=pa.array(["no number"]))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        footers.unified(spark, ranges.listed(spark, [f"{tmp_path}/b.parquet", f"{tmp_path}/g.parquet"])).collect()


def test_row_by_index(spark, tmp_path):
    sinks.write_sharded(spark.range(950).select("id", F.lit("_PEP_").alias("sequence")), str(tmp_path), "set", "train", 100)
    for index in (0, 99, 100, 555, 949):
        row = loader.row_at(spark, str(tmp_path), index)
        assert [tuple(r) for r in row.collect()] == [(index, "PEP")] and len(row.inputFiles()) == 1
    for index in (-1, 950):
        with pytest.raises(IndexError, match="of 950"):
            loader.row_at(spark, str(tmp_path), index)


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def test_edit_distances():
    """Lists of one to hundreds of tokens, on either side of a machine word, of few tokens and of more than 300 different ones."""
    r = random.Random(1)
    pairs = [([], []), ([], ["a"]), (["a"], []), (None, ["a", "b"]), (["a"], None), (["x"] * 63, ["x"] * 64), (["x"] * 64, ["x"] * 63), ([None, "a"], ["a", None])]
    for n in (1, 2, 5, 31, 62, 63, 64, 65, 130):
        for kinds in (2, 5, 400):
            for _ in range(6):
                a = [str(r.randrange(kinds)) for _ in range(n)]
                b = [t if r.random() < 0.7 else str(r.randrange(kinds)) for t in a if r.random() < 0.9] + [str(r.randrange(kinds)) for _ in range(r.randrange(4))]
                pairs += [(a, b), (b, a)]
    pairs.append(([str(k) for k in range(350)], [str(k) for k in range(349, -1, -1)]))
    kind = pa.list_(pa.string())
    left, right = pa.array([a for a, _ in pairs], kind), pa.array([b for _, b in pairs], kind)
    want = [distance(a or [], b or []) for a, b in pairs]
    assert metrics.edit_distances(left, right).tolist() == want
    assert metrics.edit_distances(left.slice(20, 50), right.slice(20, 50)).tolist() == want[20:70]


def test_error_rate_of_many_tokens(spark):
    a, b = [f"t{k}" for k in range(300)], [f"t{k}" for k in range(1, 301)]
    rows = spark.createDataFrame([(a, b), (["I", "P"], ["L", "P"]), (None, ["A"])], "t array<string>, p array<string>")
    assert tuple(metrics.aa_error_rate(rows, "t", "p").first()) == (3, 302, 3 / 302)


def test_tables_in_memory(spark):
    """pandas, Arrow and what turns into them load as files do."""
    table = pa.table({"MS/MS m/z": [500.5, None], "precursor_charge": pa.array([2, 3], pa.int8()), "modified_sequence": ["_PEP_", None], "mz_array": [[1.0, 2.0], []]})

    class Other:
        def __init__(self, how):
            setattr(self, how, lambda: table if how == "to_arrow" else table.to_pandas())

    for frame in (table, table.to_pandas(), Other("to_arrow"), Other("to_pandas")):
        rows = loader.from_frame(spark, frame, column_mapping={"MS/MS m/z": "precursor_mz"}).orderBy("precursor_charge").collect()
        assert [(r["precursor_charge"], r["sequence"], list(r["mz_array"])) for r in rows] == [(2, "PEP", [1.0, 2.0]), (3, None, [])] and rows[0]["precursor_mz"] == 500.5


def test_subset_of_a_job(spark):
    df = spark.range(100)
    assert sampling.subset_of(df, 1.0, F.col("id")).count() == 100 and sampling.subset_of(df, 0.25, F.col("id")).count() == 25
    for fraction in (0, -0.1, 1.5):
        with pytest.raises(ValueError, match="above 0 and at most 1"):
            sampling.subset_of(df, fraction, F.col("id"))
    with pytest.raises(ValueError, match="no data"):
        sampling.subset_of(df.limit(0), 1.0, F.col("id"))


def test_rows_by_a_function(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0], None), (2, [], "x"), (3, [5.0, 6.0], "y")], "id int, v array<double>, s string")
    assert [r["id"] for r in filters.filter_rows(df, lambda r: r["v"] and r["s"] != "x").collect()] == [1, 3]
    df.select(F.col("id").alias("precursor_charge"), F.lit(1.0).alias("precursor_mz"), F.array().cast("array<double>").alias("mz_array"), F.array().cast("array<double>").alias("intensity_array")).write.parquet(f"{tmp_path}/p.parquet")
    kept = loader.load_spectra(spark, f"{tmp_path}/p.parquet", preprocess=lambda d: d.where("precursor_charge > 1"))
    assert sorted(r["precursor_charge"] for r in kept.collect()) == [2, 3]
