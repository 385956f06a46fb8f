"""Order-insensitive comparison of a Spark result with a DuckDB result."""

import math
from pathlib import Path

import duckdb


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def _key(value):
    if value is None:
        return (0, "")
    if isinstance(value, float):
        return (1, "nan") if math.isnan(value) else (1, f"{value:.6f}")
    return (1, str(value))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_key(row[i]) for i in order) for row in rows)


_SAME = {
    "string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE",
    "date": "DATE", "boolean": "BOOLEAN",
}


def differences(df, con, sql) -> list[str]:
    """What differs between the two results; empty when they agree."""
    rel = con.execute(sql)
    columns = [d[0] for d in rel.description]
    kinds = {d[0]: str(d[1]) for d in rel.description}
    found = rel.fetchall()
    problems = []
    if sorted(df.columns) != sorted(columns):
        return [f"columns {sorted(df.columns)} vs {sorted(columns)}"]
    for name, kind in df.dtypes:
        if _SAME.get(kind) != kinds[name]:
            problems.append(f"type of {name}: {kind} vs {kinds[name]}")
    mine, theirs = rows_of(df.columns, df.collect()), rows_of(columns, found)
    if len(mine) != len(theirs):
        problems.append(f"rows {len(mine)} vs {len(theirs)}")
    different = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if different:
        problems.append(f"{len(different)} rows differ, first: {different[0]}")
    return problems
