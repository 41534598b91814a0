"""Comparison of a Spark result with DuckDB's on the same tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(v):
        return repr(round(v, 9) + 0.0) if isinstance(v, float) else repr(v)

    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    got = rows_of(df.columns, df.collect())
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert got == rows_of(names, found.fetchall())
