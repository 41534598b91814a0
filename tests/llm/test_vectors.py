"""Vector codes against plain Python integers."""

import math
import random

import duckdb
import numpy as np
import pytest

from peakloom.llm import queries, vector_codes
from tests.llm import fixtures
from tests.parity import compare

SCHEMA = "vec_id long, embedding array<float>, label int"


def by_brute_force(rows, parts=8, count=16, rounds=6):
    """{row place: (code, error)} and the codebooks, by Lloyd's rounds that compute every distance."""
    kept = [(k, i, [math.floor(4096 * float(np.float32(x))) for x in v]) for k, (i, v, _) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = {}
    for _, i, v in kept:
        first[i] = min(v, first.get(i, v))
    seeds = [first[i] for i in sorted(first, key=lambda i: (i is None, i or 0))[:count]]
    width = len(seeds[0]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(s)[p] for s in seeds] for p in range(parts)]
    gap = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    near = lambda x, book: min((gap(x, c), j) for j, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            of = {}
            for _, _, v in kept:
                x = cut(v)[p]
                of.setdefault(near(x, books[p])[1], []).append(x)
            books[p] = [[sum(c) // len(of[j]) for c in zip(*of[j], strict=True)] if j in of else e for j, e in enumerate(books[p])]
    found = [(k, [near(x, books[p]) for p, x in enumerate(cut(v))]) for k, _, v in kept]
    return {k: ("".join(f"{j:02x}" for _, j in f), sum(d for d, _ in f)) for k, f in found}, books


def table(seed, n, width=16):
    r = random.Random(seed)
    centres = [[r.choice([-0.5, 0.0, 0.25]) for _ in range(width)] for _ in range(5)]
    return [(i, [c + r.randrange(-3, 4) / 64 for c in r.choice(centres)], r.choice([None, 0, 1])) for i in range(n)]


@pytest.mark.parametrize(("seed", "n", "count"), [(1, 300, 16), (2, 9, 16), (3, 200, 3), (4, 200, 1)])
def test_brute_force(spark, seed, n, count):
    """Grids of few values: many vectors are as near to one entry as to another."""
    rows = table(seed, n)
    got = {r["vec_id"]: (r["code"], r["error"]) for r in vector_codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(5), entries=count).collect()}
    want, _ = by_brute_force(rows, count=count)
    assert got == want


def test_bounds_hold():
    """After every round, for random entries, each upper bound is above its distance and each lower bound below; few distances are computed."""
    r = np.random.default_rng(7)
    x = r.integers(-2000, 2000, (3000, 4))
    x[:1500] = r.integers(-3, 3, (1500, 4)) + r.choice([-900, 0, 900], (1500, 1))
    entries, moved = x[r.choice(3000, 16, False)], np.zeros(16)
    at, upper, lower = np.zeros(3000, np.int64), np.full(3000, np.inf), np.zeros((3000, 16))
    for turn in range(8):
        done = vector_codes.nearest(x, entries, moved, at, upper, lower)
        squares = ((x[:, None] - entries[None]) ** 2).sum(-1)
        assert (at == squares.argmin(axis=1)).all()
        assert (upper >= np.sqrt(squares[np.arange(3000), at])).all() and (lower <= np.sqrt(squares)).all()
        assert done < 0.6 * squares.size or turn == 0
        new = np.array([x[at == j].sum(axis=0) // max(1, (at == j).sum()) if (at == j).any() else entries[j] for j in range(16)])
        moved = np.sqrt(((new - entries) ** 2).sum(-1)) * (1 + 1e-12)
        entries = new


def test_awkward(spark, tmp_path):
    rows = table(5, 40, 8)
    same = [0.125] * 8
    rows += [(7, same, 1), (7, same, 1), (None, same, None), (None, same, 2), (50, None, 1), (51, [*same[:7], None], 1), (52, [*same[:7], float("nan")], 1), (53, [*same[:7], float("-inf")], 1)]
    rows += [(60 + k, [-0.0001] * 8, 3) for k in range(30)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"'z' as {c}" for c in ["id", "vector", "at", "upper", "lower", "code", "error", "of", "salt", "`a.b`"]])
    folder = fixtures.saved(spark, tmp_path, df, "embeddings")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet/*.parquet'")
    out = queries.op11_vector_codes(spark, folder)
    compare(out, con, queries.oracle_sql()["op11_vector_codes"])
    want, books = by_brute_force(rows)
    got = out.collect()
    assert sorted((r["code"], r["error"]) for r in got) == sorted(want.values())
    flat = ",".join(str(x) for book in books for e in book for x in e)
    assert {r["codebooks_sha256"] for r in got} == {vector_codes.hashlib.sha256(flat.encode()).hexdigest()}
    assert vector_codes.compress(df.limit(0)).count() == 0


def test_vectors_without_distances(spark):
    """Another length, and components too large for exact distances, give null; the others are coded as without them."""
    rows = table(6, 30, 8)
    odd = [(100, [0.5] * 16, 1), (101, [], 1), (102, [1e30] * 8, 1), (-1, [1e20] * 8, 0)]
    got = {r["vec_id"]: (r["code"], r["error"]) for r in vector_codes.compress(spark.createDataFrame(rows + odd, SCHEMA)).collect()}
    want, _ = by_brute_force(rows)
    assert got == want | {i: (None, None) for i, _, _ in odd}
    with pytest.raises(ValueError, match="do not divide"):
        vector_codes.compress(spark.createDataFrame([(1, [0.5] * 9, 1)], SCHEMA))


def test_many_labels(spark, monkeypatch):
    """Where totals may not be broadcast the salted join gives the same."""
    df = spark.createDataFrame(table(8, 60), SCHEMA)
    want = sorted(map(tuple, vector_codes.compress(df).collect()))
    monkeypatch.setattr(vector_codes, "bounded_broadcast", lambda df: df)
    assert sorted(map(tuple, vector_codes.compress(df).collect())) == want
