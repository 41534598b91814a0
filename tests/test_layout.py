"""The rest of the library does without its corpus subpackage."""

from pathlib import Path

import __spark_entry__


def test_nothing_else_imports_llm():
    root = Path(__spark_entry__.__file__).parent / "peakloom"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "peakloom.llm" not in p.read_text(), p


def test_sql_names_are_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
