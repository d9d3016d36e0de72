"""Compares a query's rows with those of its SQL in DuckDB."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(root: str):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{root}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return c


def plain(v):
    if v is None or v != v:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, bool):
        return str(v)
    try:
        return round(float(v), 6)
    except (TypeError, ValueError):
        return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=str)


def check(spark, root, f, sql):
    got = f(spark, root)
    c = connection(root).execute(sql)
    names = [d[0] for d in c.description]
    assert sorted(got.columns) == sorted(names)
    mine, theirs = rows_of(got.columns, [tuple(r) for r in got.collect()]), rows_of(names, c.fetchall())
    assert len(mine) == len(theirs)
    assert mine == theirs
