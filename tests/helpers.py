"""What several tests use: the driver's tables, and rows in a form that compares."""

import math

import duckdb

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def canonical(names, rows):
    """Rows sorted, columns by name, numbers as floats of nine places, NULL and NaN alike."""

    def one(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return ""
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, (int, float)):
            return repr(round(float(x), 9))
        return str(x)

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(one(r[i]) for i in order) for r in rows)


def same(frame, con, sql):
    """Whether a Spark frame and a DuckDB query give the same columns and rows."""
    found = con.sql(sql)
    assert sorted(frame.columns) == sorted(found.columns)
    return canonical(frame.columns, [tuple(r) for r in frame.collect()]) == canonical(found.columns, found.fetchall())
