"""Spark's rows beside DuckDB's, column by column name."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 4)
    return str(x) if hasattr(x, "isoformat") else x


def same(spark, name, query, sql, sf_dir) -> str:
    """Empty if both give the same rows."""
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    theirs = [d[0] for d in cur.description]
    if sorted(theirs) != cols:
        return f"{name}: columns {cols} and {sorted(theirs)}"
    order = [theirs.index(c) for c in cols]
    a = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    b = sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=str)
    if a != b:
        first = next(((x, y) for x, y in zip(a, b) if x != y), None)
        return f"{name}: {len(a)} and {len(b)} rows, first difference {first}"
    return "" if a else f"{name}: no rows"
