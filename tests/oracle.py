"""Compares a registered query with its SQL on the given tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def rows(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in records), key=repr)


def same(df, sql: str, sf_dir: str) -> None:
    got = rows([tuple(r) for r in df.collect()], df.columns)
    cur = connect(sf_dir).execute(sql)
    names = [d[0] for d in cur.description]
    want = rows(cur.fetchall(), names)
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want)
    assert got == want
