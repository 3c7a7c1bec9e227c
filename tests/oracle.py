"""Runs a query on Spark and its SQL on DuckDB, and compares rows by sorted column names."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    return tuple(norm(x) for x in v) if isinstance(v, list | tuple) else v


def duck_rows(sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return names, got.fetchall()


def order(row):
    """Exact columns first, so that last digits don't change the order."""
    return [str(x) for x in row if not isinstance(x, float)] + [f"{x:.3f}" for x in row if isinstance(x, float)]


def same(df, sql, sf_dir):
    names, want = duck_rows(sql, sf_dir)
    cols = sorted(df.columns)
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    mine = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=order)
    theirs = sorted((tuple(norm(r[i]) for i in at) for r in want), key=order)
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        assert all(x == y or isinstance(x, float) and isinstance(y, int | float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-4) for x, y in zip(a, b, strict=True)), (a, b)
