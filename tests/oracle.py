"""Each registered query against its SQL in DuckDB, on the same tables."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return value


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(repr([plain(r[i]) for i in order]) for r in values)


def differs(df, sql, db):
    """None if both give the same rows, else the first that differ."""
    found = df.collect()
    relation = db.sql(sql)
    expected = relation.fetchall()
    a, b = rows(df.columns, [tuple(r) for r in found]), rows(relation.columns, expected)
    if a == b:
        return None
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    only = [x for x in a[1] if x not in set(b[1])][:3], [x for x in b[1] if x not in set(a[1])][:3]
    return f"{len(a[1])} and {len(b[1])} rows; only in Spark: {only[0]}; only in SQL: {only[1]}"
