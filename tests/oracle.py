"""Run a query and its SQL over the same tables and compare the rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v) if hasattr(v, "isoformat") else v


def compare(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    rel = con.sql(sql)
    assert sorted(rel.columns) == names, (sorted(rel.columns), names)
    want = sorted((tuple(map(plain, r)) for r in rel.select(*[duckdb.ColumnExpression(n) for n in names]).fetchall()), key=repr)
    assert len(got) == len(want), (len(got), len(want))
    assert got == want, [(g, w) for g, w in zip(got, want) if g != w][:3]
    return len(got)
