"""Runs a query and its SQL over the same tables and compares the rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return str(value)


def compare(spark, name, query, sql, sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    found = db.sql(sql)
    wanted_columns = list(found.columns)
    wanted = found.fetchall()
    df = query(spark, sf_dir)
    assert sorted(df.columns) == sorted(wanted_columns), (name, df.columns, wanted_columns)
    columns = sorted(df.columns)
    got = sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    order = [wanted_columns.index(c) for c in columns]
    want = sorted(tuple(_plain(r[i]) for i in order) for r in wanted)
    differing = [(a, b) for a, b in zip(got, want) if a != b][:3]
    assert got == want, (name, len(got), len(want), columns, differing)
    return len(got)
