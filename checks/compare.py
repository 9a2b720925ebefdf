"""Run the registered queries next to their SQL: ``python -m checks.compare [folder] [name …]``."""

from __future__ import annotations

import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def normal(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value


def compare(spark: SparkSession, con, sf: str, name: str) -> tuple[bool, str]:
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = [tuple(normal(r[c]) for c in columns) for r in df.collect()]
    if name not in ORACLES:
        return True, f"{len(rows)} rows, no SQL"
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    if sorted(names) != columns:
        return False, f"columns {columns} against {sorted(names)}"
    order = [names.index(c) for c in columns]
    wanted = [tuple(normal(r[i]) for i in order) for r in cursor.fetchall()]
    key = lambda row: tuple((v is None, str(v)) for v in row)
    rows.sort(key=key)
    wanted.sort(key=key)
    if rows == wanted:
        return True, f"{len(rows)} rows"
    first = next(((a, b) for a, b in zip(rows, wanted) if a != b), None)
    return False, f"{len(rows)} against {len(wanted)} rows; first difference {str(first)[:500]}"


def connect(sf: str):
    con = duckdb.connect()
    for table in TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    return con


def main(arguments: list[str]) -> int:
    sf = arguments[0] if arguments else "/root/testdata/sf0.01"
    names = arguments[1:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf), 0
    for name in names:
        start = time.time()
        try:
            good, detail = compare(spark, con, sf, name)
        except Exception as exc:  # report and go on with the next query
            good, detail = False, f"{type(exc).__name__}: {str(exc)[:600]}"
        failed += not good
        print(f"{'ok  ' if good else 'FAIL'} {name}: {detail} [{time.time() - start:.1f} s]", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
