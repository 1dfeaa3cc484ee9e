"""Runs a query and its SQL over the same tables and compares all rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


def differences(spark, db, function, sql: str, sf_dir: str) -> str:
    """Empty if the query and its SQL agree in columns and rows, else what differs."""
    found = function(spark, sf_dir)
    told = db.execute(sql)
    names = [d[0] for d in told.description]
    if sorted(names) != sorted(found.columns):
        return f"columns {sorted(found.columns)} against {sorted(names)}"
    a, b = rows(found.columns, [tuple(r) for r in found.collect()]), rows(names, told.fetchall())
    if a == b:
        return ""
    only_a, only_b = [x for x in a if x not in set(map(repr, b)) and x not in b][:3], [x for x in b if x not in a][:3]
    return f"{len(a)} rows against {len(b)}; {sorted(found.columns)}; only in Spark {only_a}; only in SQL {only_b}"
