"""Runs registered queries and their SQL side by side."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sf_dir: str, sql: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.sql(sql).df()


def normal(frame) -> list[tuple]:
    """Rows in a comparable form: columns by name, numbers by value."""
    names = sorted(frame.columns)
    plain = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, int | float) or hasattr(v, "dtype") else v
    return sorted((tuple(plain(v) for v in row) for row in frame[names].itertuples(index=False)), key=repr)


def difference(spark_frame, sql_frame) -> str:
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} and {sorted(sql_frame.columns)}"
    a, b = normal(spark_frame), normal(sql_frame)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else ""
