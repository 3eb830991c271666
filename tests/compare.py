"""A Spark result against a DuckDB result, as sets of rows with columns in order of name."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(path := f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{path}'")
    return con


def cell(v):
    return round(v, 6) if isinstance(v, float) and math.isfinite(v) else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(cell(r[k]) for k in order) for r in rows), key=repr)


def same(df, con, sql):
    got = rows_of(df.columns, df.collect())
    r = con.execute(sql)
    want = rows_of([c[0] for c in r.description], r.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
    return got[1]
