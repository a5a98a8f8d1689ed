"""Value comparison of a Spark result with a DuckDB statement on the same tables."""

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def _sortable(row: tuple) -> tuple:
    return tuple((value is None, str(type(value)), value if value is not None else 0) for value in row)


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    """Rows with columns in name order, sorted."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=_sortable)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), rows_of(df.columns, [tuple(row) for row in df.collect()])


def duckdb_rows(db, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = db.execute(sql)
    columns = [item[0] for item in cursor.description]
    return sorted(columns), rows_of(columns, cursor.fetchall())


def difference(got: list[tuple], expected: list[tuple]) -> str | None:
    """The first difference; floats must agree to the last digits, other values fully."""
    if len(got) != len(expected):
        return f"{len(got)} rows, expected {len(expected)}"
    for a, b in zip(got, expected):
        for x, y in zip(a, b):
            if isinstance(x, float) and isinstance(y, float):
                same = math.isclose(x, y, rel_tol=1e-12, abs_tol=1e-12)
            else:
                same = x == y and type(x) is type(y)
            if not same:
                return f"{a} expected {b}"
    return None
