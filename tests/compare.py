"""Side-by-side check of a Spark result and a DuckDB result."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if value is None:
        return "~null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    if hasattr(value, "as_integer_ratio") and not isinstance(value, int):
        return repr(float(value))
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_plain(v) for v in value) + "]"
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> list[str]:
    """Empty when both sides agree; otherwise a few lines that say how they differ."""
    cursor = con.execute(sql)
    theirs_cols = [d[0] for d in cursor.description]
    theirs = rows_of(theirs_cols, cursor.fetchall())
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    problems = []
    if sorted(df.columns) != sorted(theirs_cols):
        problems.append(f"columns {sorted(df.columns)} vs {sorted(theirs_cols)}")
    if len(mine) != len(theirs):
        problems.append(f"rows {len(mine)} vs {len(theirs)}")
    kinds = {n: str(t).split("(")[0] for n, t in zip(theirs_cols, [d[1] for d in cursor.description])}
    for name, dtype in df.dtypes:
        other = kinds.get(name, "")
        numeric_mismatch = dtype.startswith("decimal") or (dtype == "double") != (other in ("DOUBLE", "NUMBER", "FLOAT"))
        if numeric_mismatch and other in ("DECIMAL", "HUGEINT", "DOUBLE", "BIGINT", "INTEGER", "NUMBER"):
            problems.append(f"type of {name}: {dtype} vs {other}")
    if not problems and mine != theirs:
        bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
        problems.append(f"{len(bad)} rows differ, e.g.\n   spark {bad[0][0]}\n   duck  {bad[0][1]}")
    return problems
