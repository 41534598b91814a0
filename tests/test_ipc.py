"""Arrow files by record batches, and folders of them that failing tasks leave whole."""

import pathlib

import pyarrow as pa
import pytest
from pyspark import TaskContext

from peakloom.sources import ipc, loader, sinks

TABLE = pa.table({"scan_number": list(range(5000)), "mz_array": [[float(i), 0.5] for i in range(5000)], "extra": [None if i % 3 else f"t{i}" for i in range(5000)]})


def put(path, table, rows):
    with pa.OSFile(str(path), "wb") as sink, pa.ipc.new_file(sink, table.schema) as writer:
        writer.write_table(table, max_chunksize=rows)


def test_one_file_over_many_tasks(spark, tmp_path):
    put(tmp_path / "a.arrow", TABLE, 100)
    put(tmp_path / "b.arrow", TABLE.slice(0, 10), 100)
    rows = ipc.load(spark, str(tmp_path), 10_000)
    assert rows.rdd.getNumPartitions() >= 6
    assert sorted(map(tuple, rows.select("scan_number", "extra").collect()), key=repr) == sorted([(i, TABLE["extra"][i].as_py()) for i in [*range(5000), *range(10)]], key=repr)
    assert sorted(r["mz_array"] for r in loader.read_ipc(spark, f"{tmp_path}/*.arrow").where("scan_number < 2").collect()) == [[0.0, 0.5]] * 2 + [[1.0, 0.5]] * 2


def test_runs_of_batches(tmp_path):
    put(tmp_path / "a.arrow", TABLE, 100)
    put(tmp_path / "none.arrow", TABLE.slice(0, 0), 100)
    files = pa.RecordBatch.from_pydict({"place": [0, 1], "uri": [f"file:{tmp_path}/a.arrow", f"file:///{tmp_path}/none.arrow"], "size": [1000, 1000]})
    found = next(ipc._footers(60)([files])).to_pylist()
    assert [(r["first"], r["count"]) for r in found if r["place"] == 0] == [(3 * k, min(3, 50 - 3 * k)) for k in range(17)] and [r["count"] for r in found if r["place"] == 1] == [0]


def test_other_schemas(spark, tmp_path):
    put(tmp_path / "a.arrow", TABLE.slice(0, 5), 100)
    put(tmp_path / "b.arrow", TABLE.slice(5, 5).select(["extra", "mz_array", "scan_number"]).cast(pa.schema([("extra", pa.string()), ("mz_array", pa.list_(pa.float32())), ("scan_number", pa.int32())])), 100)
    assert sorted(r["scan_number"] for r in ipc.load(spark, str(tmp_path)).collect()) == list(range(10))
    put(tmp_path / "c.arrow", TABLE.select(["extra"]), 100)
    with pytest.raises(Exception, match="lacks the columns"):
        ipc.load(spark, str(tmp_path)).collect()


def test_a_task_that_fails_leaves_nothing(spark, tmp_path):
    """A task fails once all its rows are written: the whole write fails, the folder stays as it was, and the next write has every row once."""
    target, df = f"{tmp_path}/out", spark.range(1000).repartition(4)
    assert len(sinks.write_ipc(df, target)) == 4
    seen = lambda: sorted(p.name for p in pathlib.Path(target).iterdir() if p.name[0] != "_")  # what other tasks put aside as the write failed is hidden
    before = seen()

    def failing(batches):
        yield from batches
        if TaskContext.get().partitionId() == 3:
            raise ValueError("lost after writing")

    with pytest.raises(Exception, match="lost after writing"):
        sinks.write_ipc(df.mapInArrow(failing, "id long"), target)
    assert seen() == before
    sinks.write_ipc(df, target)
    assert sorted(r["id"] for r in ipc.load(spark, target).collect()) == sorted([*range(1000)] * 2)
    sinks.write_ipc(df, target, "overwrite")
    assert sorted(r["id"] for r in ipc.load(spark, target).collect()) == list(range(1000))
    sinks.write_ipc(df.where("id < 0"), target, "overwrite")
    assert ipc.load(spark, target).count() == 0


def test_a_repeated_task_counts_once(tmp_path):
    """Two attempts of one task both write; only the one whose message is committed is seen."""
    from pyspark.sql.types import LongType, StructField, StructType

    writer = ipc.IpcWriter({"path": f"file:{tmp_path}/out"}, StructType([StructField("id", LongType())]), False)
    batch = pa.RecordBatch.from_pydict({"id": [1, 2]})
    first, again = writer.write(iter([batch])), writer.write(iter([batch]))
    assert first.path != again.path
    writer.commit([again, ipc.Written(None)])
    assert [p.name for p in (tmp_path / "out").iterdir()] == [again.path]
