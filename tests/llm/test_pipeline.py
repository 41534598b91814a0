"""The corpus pipeline against plain Python, stage by stage."""

from collections import Counter

import corpus_pipeline
from peakloom.llm import langid
from tests.llm import fixtures
from tests.llm.test_models import near_by_brute_force
from tests.llm.test_tokens import check_packing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def unique_rows():
    seen, out = set(), []
    for r in fixtures.rows():
        if r[0] is not None and r[0] not in seen:
            seen.add(r[0])
            out.append(r)
    return out


def test_stages(spark):
    docs = spark.createDataFrame(unique_rows(), fixtures.SCHEMA)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, "unused"), "test")
        assert docs.columns == COLUMNS
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    lettered = {r[0] for r in unique_rows() if any(c.isalpha() for c in r[1] or "")}
    assert set(kept["language_id"]) <= lettered and {r[0] for r in unique_rows()[:36]} <= set(kept["language_id"])
    words = {i: len(t.split()) for i, t in kept["quality_rules"].items()}
    assert min(words.values()) >= 20 and 140 not in words and 230 not in words and set(kept["language_id"]) - set(words) <= {134, 135, 136, 140, 142, 230}
    line = "Shared line of the site here"
    for i, text in kept["quality_rules"].items():
        if kept["language_id"][i] != text:  # only struck lines are gone
            assert 201 <= i < 225 and f"{line}\n{text}" == kept["language_id"][i]
    assert sum(line in t for t in kept["quality_rules"].values()) == 1
    folded = Counter(t.lower() for t in kept["quality_rules"].values())
    assert Counter(t.lower() for t in kept["exact_dedup"].values()) == Counter(folded.keys())
    classes = near_by_brute_force(list(kept["exact_dedup"].items()))
    assert set(kept["near_dedup"]) == {c for _, c, _ in classes}
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, "unused").collect()
    made, bound = check_packing(rows, kept["near_dedup"])
    assert made <= bound + 1


def test_run(spark, tmp_path):
    folder = fixtures.saved(spark, tmp_path, fixtures.documents(spark).where("doc_id is not null").dropDuplicates(["doc_id"]))
    rows = corpus_pipeline.run(spark, folder).collect()
    # The quality stage strikes the hot host's shared line from all its texts but the first.
    texts = {r[0]: r[1].split("\n", 1)[1] if r[3] == "hot" and r[0] != 200 else r[1] for r in unique_rows() if r[1]}
    assert rows and check_packing(rows, {k: texts[k] for k in {r["doc_id"] for r in rows}})[0] == len({r["sequence_id"] for r in rows})


def test_awkward_and_empty(spark, tmp_path):
    folder = fixtures.saved(spark, tmp_path, fixtures.documents(spark, clashing=True))
    assert corpus_pipeline.run(spark, folder).count() > 0
    assert corpus_pipeline.run(spark, fixtures.saved(spark, tmp_path / "e", fixtures.empty(spark))).count() == 0


def test_drops_go_by_row(spark):
    """Null and repeated ids: a row goes or stays by its own values, and copies leave one row."""
    long = {k: fixtures.prose(k, 60, "own") for k in fixtures.WORDS}
    values = [(None, long["en"], "en", "s0", 0), (None, None, "en", "s0", 0), (None, "too short", "en", "s0", 0), (7, long["de"], "de", "s1", 0), (7, "short too", "en", "s1", 0),
              (None, long["fr"], "fr", None, 0), (None, long["fr"], "fr", None, 0), (7, long["de"], "de", "s1", 0), (3, long["en"].upper(), "en", "s0", 0), (None, "12 34 !!", "fr", "s0", 0)]
    docs = spark.createDataFrame(values, fixtures.SCHEMA)
    listed = lambda rows: sorted(map(tuple, rows), key=repr)
    stages = dict(corpus_pipeline.STAGES)
    lettered = [r for r in values if any(c.isalpha() for c in r[1] or "")]
    assert set(listed(stages["language_id"](spark, docs, "unused").collect())) <= set(lettered)
    good = [r for r in values if len((r[1] or "").split()) >= 20]
    assert listed(stages["quality_rules"](spark, docs, "unused").collect()) == listed(good)
    short = [(3, "too short".upper(), "en", "s0", 0), (7, "12 34 !!", "fr", "s0", 0)]
    want = listed([values[8], values[3], values[5], values[1], values[2], values[4], values[9]])
    assert listed(stages["exact_dedup"](spark, docs, "unused").collect()) == want
    assert listed(stages["near_dedup"](spark, docs, "unused").collect()) == want
    more = spark.createDataFrame(values + short, fixtures.SCHEMA)
    want = listed([values[8], values[3], values[5], values[1], values[4], *short])
    assert listed(stages["near_dedup"](spark, more, "unused").collect()) == want


def test_texts_go_to_python_in_small_batches(spark):
    """A batch of whole texts has a bounded number of rows, also where the session's setting is larger or unbounded."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for given, then in (("10000", "1000"), ("0", "1000"), ("7", "7")):
            spark.conf.set(name, given)
            langid.predict(spark.createDataFrame([(1, "a text")], "doc_id long, text string"), langid.LanguageModel((), ()))
            assert spark.conf.get(name) == then
    finally:
        spark.conf.set(name, before)
