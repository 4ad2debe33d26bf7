"""Compares queries with their SQL: same columns, same rows in any order, numbers to 6 places."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if value is None or isinstance(value, (str, bool, int)):
        return value
    if hasattr(value, "as_tuple"):
        return round(float(value), 6)
    return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def differences(df, con, sql):
    got_columns, got = df.columns, [tuple(r) for r in df.collect()]
    found = con.execute(sql)
    want_columns = [c[0] for c in found.description]
    assert sorted(got_columns) == sorted(want_columns), (got_columns, want_columns)
    a, b = rows(got_columns, got), rows(want_columns, found.fetchall())
    return len(a), len(b), [(x, y) for x, y in zip(a, b) if x != y][:3]
