"""The seed index against a plain search."""

import random
from pathlib import Path

import pytest

from peakloom import storage
from peakloom.operators import joins, substrings
from peakloom.plans import mapping
from peakloom.sources import loader, sinks


def places(strings, texts):
    return sorted({(s, i, p) for s in set(strings) if s for i, t in texts if t is not None for p in range(len(t) - len(s) + 1) if t.startswith(s, p)}, key=repr)


def cases():
    r = random.Random(5)
    texts = [(k, "".join(r.choices("ABC", k=r.randrange(0, 60)))) for k in range(40)]
    texts += [(50, None), (51, ""), (52, "A" * 300), (52, "A" * 300), (52, "OTHER TEXT OF ONE ID"), (None, "ABCABCABC"), (53, "wörter 𝔘ber ß"), (54, "L" * 3)]
    strings = ["".join(r.choices("ABC", k=n)) for n in range(1, 12) for _ in range(4)]
    return strings + ["A" * 20, "A", "", None, "ß", "𝔘ber", "ZZZZZZZ", "OTHER TEXT OF ONE ID", "wörter 𝔘ber ß and more"], texts


@pytest.mark.parametrize("way", ["plain", "salted"])
def test_all_places(spark, monkeypatch, way):
    """Every place is found, by windows that are rare or in every text, for strings shorter and longer than a window."""
    if way == "salted":
        monkeypatch.setattr(substrings, "HOT", 5)
        monkeypatch.setattr(substrings, "ROWS", 7)
        monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(joins.bounded_broadcast, "__defaults__", (0,))
    strings, texts = cases()
    a = spark.createDataFrame([(s,) for s in strings], "s string")
    b = spark.createDataFrame(texts, "id long, body string")
    got = sorted(map(tuple, substrings.occurrences(a, "s", b, "id", "body", 4).collect()), key=repr)
    assert got == places(strings, texts)


@pytest.mark.parametrize("way", ["in tasks", "in small chunks", "by the index"])
def test_holders(spark, monkeypatch, way):
    """Each row of texts counts, with the first place in it, also where ids repeat or are null and where a text is cut into chunks."""
    if way == "in small chunks":
        monkeypatch.setattr(substrings, "CHUNK", 16)
        monkeypatch.setattr(substrings, "PAIRS", 3)
    if way == "by the index":
        monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    strings, texts = cases()
    a = spark.createDataFrame([(s,) for s in strings], "s string")
    b = spark.createDataFrame(texts, "id long, body string")
    got = sorted(map(tuple, substrings.holders(a, "s", b, "id", "body", 4).collect()), key=repr)
    assert got == sorted(((s, i, t.index(s)) for s in set(strings) if s for i, t in texts if t and s in t), key=repr)
    if way == "in small chunks":
        got = sorted(map(tuple, substrings.occurrences(a, "s", b, "id", "body", 4).collect()), key=repr)
        assert got == places(strings, texts)


def test_mapping_writes_each_peptide_once(spark):
    """The files of a mapping grow with predictions and with pairs, and not with predictions times proteins."""
    mark = storage.made()
    mapping.mapping_csv_counts(spark, "/root/testdata/sf0.01").collect()
    n = spark.read.parquet("/root/testdata/sf0.01/orders.parquet").count()
    files = [f for d in storage._made[mark:] for f in Path(d.removeprefix("file:")).rglob("part-*")]
    assert 0 < sum(f.stat().st_size for f in files) < 300 * n
    storage.cleared(spark)


def test_words_count_rows(spark, tmp_path):
    """Documents with repeated and null ids count one by one, as in the query's SQL."""
    spark.createDataFrame([(1, "a b the c")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "The end"), (1, "other"), (None, "the"), (None, None), (2, "no")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in mapping.words_in_documents(spark, str(tmp_path)).collect()] == [("the", 3)]


def test_map_peptides_without_lists(spark):
    df = spark.createDataFrame([(1, "KLLIV"), (2, "WWWW"), (3, None)], "id long, peptide string")
    proteins = spark.createDataFrame([("P2", "MKLLIVE"), ("P1", "AKIIIVKIILVK"), ("P1", "KLLIV")], "acc string, seq string")
    got = substrings.map_peptides(df, "peptide", proteins, "acc", "seq", lists=False)
    assert "protein_ids" not in got.columns
    assert sorted((r["id"], r["protein_id"], r["n_proteins"]) for r in got.collect()) == [(1, "P1", 2), (2, None, 0), (3, None, 0)]


def test_no_nested_loop(spark):
    a = spark.createDataFrame([("ABCDEFGH",)], "s string")
    b = spark.createDataFrame([(1, "xxABCDEFGHxx")], "id long, body string")
    plan = substrings.occurrences(a, "s", b, "id", "body")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_map_peptides(spark):
    proteins = [("P1", "MKILLVEEDR"), ("P2", "MKLLIVEEDRPEPTIDE"), ("P3", None), ("P4", "PEPTLDEMM")]
    peptides = [(1, "KLLIV", "x"), (2, "PEPT[UNIMOD:21]IDE", "x"), (3, "M[UNIMOD:35]M", "x"), (4, None, "x"), (5, "", "x"), (6, "WWWW", "x"), (1, "KLLIV", "x")]
    df = spark.createDataFrame(peptides, "id long, peptide string, string string")
    rows = substrings.map_peptides(df, "peptide", spark.createDataFrame(proteins, "acc string, seq string"), "acc", "seq", 3).collect()
    assert sorted((r["id"], tuple(r["protein_ids"]), r["protein_id"], r["n_proteins"]) for r in rows) == [
        (1, ("P1", "P2"), "P1", 2), (1, ("P1", "P2"), "P1", 2), (2, ("P2", "P4"), "P2", 2), (3, ("P4",), "P4", 1), (4, (), None, 0), (5, (), None, 0), (6, (), None, 0)
    ]


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">sp|P1|NAME one\nMKIL\r\nVVEE\n>plain second\n\nPEP TIDE\n>empty\n>last\nA*")
    rows = loader.read_fasta(spark, f"{tmp_path}/a.fasta").collect()
    assert [tuple(r) for r in rows] == [("P1", "sp|P1|NAME one", "MKILVVEE"), ("plain", "plain second", "PEPTIDE"), ("empty", "empty", ""), ("last", "last", "A*")]
    sinks.write_fasta(spark.createDataFrame([("Q1", "AAA"), ("Q2", None)], "id string, s string"), f"{tmp_path}/out", "id", "s")
    assert sorted((r["protein_id"], r["sequence"]) for r in loader.read_fasta(spark, f"{tmp_path}/out").collect()) == [("Q1", "AAA"), ("Q2", "")]
