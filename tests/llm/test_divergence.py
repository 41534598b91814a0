"""Divergence of sources against plain Python and SQL."""

import random
import re
from collections import Counter

import duckdb
import pytest

from peakloom.llm import divergence, queries
from tests.llm import fixtures
from tests.parity import compare

SCHEMA = "doc_id long, text string, lang string, source string"


def by_brute_force(rows, least, top):
    counts, docs, groups = {}, Counter(), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        counts.setdefault((lang, source), Counter()).update(terms)
        docs.update((lang, t) for t in set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        terms = sorted(t for k, t in docs if k == lang and docs[k, t] >= least)
        sources = sorted(s for k, s in groups if k == lang)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[u] for u in terms) + 5 * len(terms)) for t in terms}  # noqa: B023, E731
        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in terms), o.encode()) for o in sources if o != s)
            own = sorted((q[t] - p[s][t], t.encode()) for t in terms if counts[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, i.decode(), -v, k + 1) for part, found in (("pair", pairs), ("term", own)) for k, (v, i) in enumerate(found)]
    return sorted(out)


def rows():
    r = random.Random(3)
    words = ["the", "The", "haus", "élan", "naïve", "x1y", "AÉ", "zz", "wörter", "tail", "don't", "日本", "𝔘n"]
    out = []
    for i in range(400):
        weights = [1 + (hash_(i % 9, k) % 7) ** 2 for k in range(len(words))]
        out.append((i, " ".join(r.choices(words, weights, k=r.randrange(0, 12))), r.choice(["en", "en", "de"]), f"s{i % 9}"))
    out += [(500, None, None, None), (501, "", "fr", "a"), (502, "rare", "fr", "b"), (503, "rare", "it", "only"), (None, "the the", "en", None), (None, "the the", "en", None), (504, "B" * 100_000, "en", "s1")]
    return out


def hash_(a, b):
    return (a * 2654435761 + b * 40503) % 65521


@pytest.mark.parametrize(("side", "held"), [(128, 200_000), (4, 3)])
def test_brute_force(spark, monkeypatch, side, held):
    """Many tiles on both sides, and tasks that pass their counts on early, give the same."""
    monkeypatch.setattr(divergence, "SOURCES", side)
    monkeypatch.setattr(divergence, "TERMS", 2 if side == 4 else 128)
    monkeypatch.setattr(divergence, "HELD", held)
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    got = sorted(map(tuple, divergence.audit(df, least=5, top=3).collect()))
    assert got == by_brute_force(rows(), 5, 3)


def test_like_sql_on_awkward_rows(spark, tmp_path):
    df = spark.createDataFrame(rows() + [r[:4] for r in fixtures.rows()], SCHEMA)
    df = df.selectExpr("*", *[f"'z' as {c}" for c in ["term", "n", "docs", "total", "first", "block", "side", "other", "place", "item", "value", "rank", "part", "`a.b`"]])
    folder = fixtures.saved(spark, tmp_path, df)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    compare(queries.op12_source_divergence(spark, folder), con, queries.oracle_sql()["op12_source_divergence"])
    assert divergence.audit(df.limit(0)).count() == 0


def test_long_division():
    np = divergence.np
    part, whole = np.array([5, 10**14 + 7, 9 * 10**15 - 1, 3, 9 * 10**15]), np.array([7, 10**15, 9 * 10**15, 3, 9 * 10**15])
    assert divergence.scaled(part, whole).tolist() == [10**9 * int(a) // int(b) for a, b in zip(part, whole, strict=True)]
