"""Tables in the shared folder."""

from pathlib import Path

from peakloom import storage


def test_removed_since_keeps_one(spark):
    before = storage.written(spark.range(2), "before")
    mark = storage.made()
    first, second, empty = (storage.written(spark.range(n), f"t{n}") for n in (3, 4, 0))
    there = lambda df: [Path(f.removeprefix("file:")).exists() for f in df.inputFiles()]
    files = first.inputFiles()
    storage.removed_since(spark, mark, second)
    assert storage.made() == mark + 1 and all(there(second)) and all(there(before)) and not any(Path(f.removeprefix("file:")).exists() for f in files)
    assert second.count() == 4 and before.count() == 2 and empty is not None
    assert storage.folder(spark, "x").startswith(storage.shared_dir(spark))
