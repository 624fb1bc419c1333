"""Compare every registered query with its SQL, or run it if it has none.

    python tests/check_queries.py [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import tempfile
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as registry


SCRATCH = tempfile.TemporaryDirectory(prefix="tests-")  # goes when the process ends


def local_session(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", SCRATCH.name)
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(folder).glob("*.parquet")):
        files = f"{path}/*.parquet" if path.is_dir() else path
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{files}'")
    return con


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


def sortable(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    body = [tuple(normal(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(body, key=sortable)


def differences(spark, con, folder: str, name: str) -> str | None:
    """None if equal, else what differs."""
    df = registry.queries()[name](spark, folder)
    ours = table_of(df.columns, [tuple(r) for r in df.collect()])
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return None if ours[1] else "no rows"
    result = con.execute(sql)
    theirs = table_of([d[0] for d in result.description], result.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} <> {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"rows {len(ours[1])} <> {len(theirs[1])}"
    unequal = [(a, b) for a, b in zip(ours[1], theirs[1]) if a != b]
    return f"{len(unequal)} of {len(ours[1])} rows, first {unequal[0]}" if unequal else None


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(registry.queries())
    spark, con = local_session(), connect(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            found = differences(spark, con, folder, name)
        except Exception as error:
            found = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += found is not None
        kind = "sql" if name in registry.oracle_sql() else "rows"
        print(f"{name:28s} {kind:5s} {time.time() - start:6.1f}s {found or 'ok'}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    spark.stop()


if __name__ == "__main__":
    main()
