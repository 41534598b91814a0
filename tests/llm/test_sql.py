"""Operators that SQL can express, on test data and on the awkward cases."""

import duckdb
import pytest
from pyspark.sql import functions as F

from peakloom import storage
from peakloom.llm import chat, exact_dedup, queries, quality_rules, token_counts
from tests.llm import fixtures
from tests.parity import compare, connect

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, spark, sf):
    compare(queries.queries()[name](spark, sf), connect(sf), SQL[name])


@pytest.mark.parametrize("name", [n for n in sorted(SQL) if n.split("_")[0] not in ("op3", "op11", "op13")])
@pytest.mark.parametrize("kind", ["awkward", "empty"])
def test_awkward_documents(name, kind, spark, tmp_path):
    df = fixtures.documents(spark, clashing=True) if kind == "awkward" else fixtures.empty(spark)
    folder = fixtures.saved(spark, tmp_path, df)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    compare(queries.queries()[name](spark, folder), con, SQL[name])


def test_awkward_conversations(spark, tmp_path):
    rows = [(1, 0, "user", "hi"), (1, 1, "bot", None), (1, 1, "bot", None), (1, 1, "ann", "<|end|> <|assistant|>"), (1, None, None, "?"), (1, 5000, "user", "far"),
            (4, 0, 'x"|>', "who"), (4, 1, "<|y", "me"),
            (2, 0, "user", ""), (None, 0, "a", "x"), (None, 1, "b", "y"), (3, 0, None, "nobody")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("own", "said", "speaker", "block", "at")})
    folder = fixtures.saved(spark, tmp_path, df, "conversations")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{folder}/conversations.parquet/*.parquet'")
    compare(queries.op3_perspectives(spark, folder), con, SQL["op3_perspectives"])
    assert chat.perspectives(df.limit(0)).count() == 0
    whole = "".join(r["segment"] for r in chat.perspectives(df.where("conv_id = 1")).where("perspective = 'bot'").orderBy("seg_start").collect())
    heads = {r["segment"] for r in chat.perspectives(df.where("conv_id = 4")).collect()}
    assert '<|user name="x\\"| >"|>who<|end|>\n' in heads and '<|user name="< |y"|>me<|end|>\n' in heads
    assert whole.count("<|assistant|>") == 2 and whole.endswith("far<|end|>\n")


def test_dropping(spark):
    docs = fixtures.documents(spark, clashing=True)
    out = exact_dedup.drop_exact_copies(docs)
    assert out.columns == docs.columns
    norm = F.translate(F.coalesce("text", F.lit("")), exact_dedup.UPPER, exact_dedup.UPPER.lower())
    assert out.groupBy(norm).count().where("count > 1").count() == 0 and out.select(norm).distinct().count() == docs.select(norm).distinct().count()
    ids = {r[0] for r in out.select("doc_id").collect()}
    assert 102 in ids and 100 not in ids and 131 in ids and 130 not in ids
    good = quality_rules.keep_good(docs)
    kept = {r[0]: r[1] for r in good.select("doc_id", "text").collect()}
    assert good.columns == docs.columns
    assert 230 not in kept and 205 in kept and 140 not in kept and 141 in kept and 131 not in kept
    line = "Shared line of the site here"
    assert line in kept[200] and line not in kept[205] and kept[205] == fixtures.prose("en", 30, "s5")
    whole = {r[0]: r[1] for r in quality_rules.keep_good(docs, strike=False).select("doc_id", "text").collect()}
    assert whole.keys() == kept.keys() and whole[205] == f"{line}\n{kept[205]}"


def test_struck_texts(spark, tmp_path):
    """Texts are rebuilt without the struck lines, in order; the first carrier keeps its lines."""
    line = "Shared line of the site here"
    more = [(300, f"top\n\n {line.upper()} \nmiddle\n{line}\n\nend", "en", "hot", 0), (None, f"{line}\nnull id", "en", "hot", 0), (301, f"{line}\nelsewhere", "en", None, 0)]
    rows = fixtures.rows() + more
    folder = fixtures.saved(spark, tmp_path, spark.createDataFrame(rows, fixtures.SCHEMA).withColumns({c: F.lit("z") for c in fixtures.CLASHING}))
    same = lambda raw: " ".join(raw.lower().split()) == line.lower()
    want = [(i, s, t if s != "hot" or i == 200 else "\n".join(x for x in t.split("\n") if not same(x))) for i, t, _, s, _ in rows]
    assert sorted(map(tuple, queries.op4_struck_texts(spark, folder).collect()), key=repr) == sorted(want, key=repr)
    assert ("hot", "top\n\nmiddle\n\nend") in {w[1:] for w in want}


def test_struck_by_row(spark, tmp_path):
    """Thirty texts of one host share a line: whatever their ids are, one keeps it. So do thirty rows of one text, which is one text."""
    line = "A line that all of them share"
    texts = [f"{line}\n{fixtures.prose('en', 40, f'row{k}')}" for k in range(30)]
    for name, ids in {"own": range(30), "null": [None] * 30, "one": [7] * 30, "some": [None] * 15 + [7] * 15}.items():
        rows = [(i, t, "en", "h", 0) for i, t in zip(ids, texts, strict=True)]
        found = quality_rules.judge(spark.createDataFrame(rows, fixtures.SCHEMA).repartition(3)).collect()
        assert sorted(r["n_struck_words"] for r in found) == [0] + [7] * 29, name
        left = quality_rules.struck_texts(spark.createDataFrame(rows, fixtures.SCHEMA)).collect()
        assert sum(line in r["text"] for r in left) == 1 and all(r["kept"] for r in found)
        folder = fixtures.saved(spark, tmp_path / name, spark.createDataFrame(rows, fixtures.SCHEMA))
        con = duckdb.connect()
        con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
        compare(queries.op4_line_frequency(spark, folder), con, SQL["op4_line_frequency"])
    copies = [(i, texts[0], "en", "h", 0) for i in range(30)]
    assert {r["n_struck_words"] for r in quality_rules.judge(spark.createDataFrame(copies, fixtures.SCHEMA)).collect()} == {0}


def test_hot_copies(spark, tmp_path, monkeypatch):
    """Large groups, also of one row repeated, find their winner without being dealt by digest."""
    monkeypatch.setattr(exact_dedup, "HOT", 20)
    rows = [(7, "Same text")] * 300 + [(k, "SAME text") for k in range(50)] + [(None, "null")] * 40 + [(None, None)] * 25 + [(k, f"t{k // 2}") for k in range(40)]
    folder = fixtures.saved(spark, tmp_path, spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    compare(queries.op7_exact_dedup(spark, folder), con, SQL["op7_exact_dedup"])


def test_clashing_names_keep_their_values(spark):
    """Every stage gives back all columns as they were, whatever their names are."""
    import corpus_pipeline

    docs = fixtures.documents(spark).withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) for c in fixtures.CLASHING})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "unused")
        assert out.columns == docs.columns, name
        wrong = [F.col(f"`{c}`") != F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) for c in fixtures.CLASHING]
        assert out.where(F.array_contains(F.array(*wrong), True)).count() == 0 < out.count(), name
    assert quality_rules.struck_texts(docs).columns == docs.columns


def test_digest_clash(spark, monkeypatch):
    """Two texts under one digest stay two groups."""
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.substring(F.md5(c), 1, 0), raising=True)
    df = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b"), (4, "c"), (5, "c")], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(df).collect()}
    assert got == {1: (2, 2), 2: (2, 2), 3: (3, 1), 4: (5, 2), 5: (5, 2)}


def test_ledger(spark, tmp_path):
    df = spark.createDataFrame([("s", "en", "v1", 5), ("s", "en", "v1", 7), (None, None, "v1", None)], "source string, lang string, version string, tokens long")
    ledger = token_counts.TokenLedger(spark, f"file://{tmp_path}/ledger")
    assert ledger.totals().count() == 0
    assert ledger.commit("1", token_counts.inserts(df)) and not ledger.commit("1", token_counts.inserts(df))
    assert ledger.commit("2", token_counts.revisions(df.where("tokens = 5"), df.where("tokens = 5").withColumn("tokens", F.lit(6))))
    assert ledger.commit("3", token_counts.deletes(df.where("source is null"))) and ledger.commit("4", token_counts.inserts(df.limit(0)))
    again = token_counts.TokenLedger(spark, f"file://{tmp_path}/ledger")
    assert [tuple(r) for r in again.totals().collect()] == [("s", "en", "v1", 2, 13)]


def test_ledger_of_two_writers(spark, tmp_path, monkeypatch):
    """Two writers of one batch, each of whom sees none before it writes: the batch counts once. Ids may be any texts."""
    row = spark.createDataFrame([("s", "en", "v1", 5, "x")], "source string, lang string, version string, tokens long, d_tokens string")
    one, two = (token_counts.TokenLedger(spark, f"file://{tmp_path}/ledger") for _ in range(2))
    odd = "a/b=c:*?\n"
    assert one.commit("x", token_counts.inserts(row))
    with monkeypatch.context() as m:
        m.setattr(token_counts.TokenLedger, "committed", lambda self, batch_id: False)
        assert one.commit(odd, token_counts.inserts(row)) and not two.commit(odd, token_counts.inserts(row))
    assert [tuple(r) for r in two.totals().collect()] == [("s", "en", "v1", 2, 10)]
    state = one._state()
    monkeypatch.setattr(token_counts.TokenLedger, "_state", lambda self: state)
    assert one.compact() and not two.compact()  # both from the same state: the first stands
    monkeypatch.undo()
    assert not one.commit(odd, token_counts.inserts(row)) and two.commit("y", token_counts.inserts(row))
    assert [tuple(r) for r in one.totals().collect()] == [("s", "en", "v1", 3, 15)]
    two.vacuum()
    assert one.committed("x") and one.committed("y") and [tuple(r) for r in one.totals().collect()] == [("s", "en", "v1", 3, 15)]
    assert one.compact() and len(one._state()[0]) == 1 and one.totals().count() == 1


def test_written_tables_are_cleared(spark):
    df = storage.written(spark.range(3), "cleared")
    kept = storage.written(spark.range(3), "cleared")
    storage.removed(df)
    assert kept.count() == 3 and storage.cleared(spark) >= 1 and storage.cleared(spark) == 0
