"""Compare every registered query with its SQL in DuckDB: ``python -m checks.run <sf_dir> [name ...]``."""

from __future__ import annotations

import sys
import time
from decimal import Decimal

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def session(cores: str = "8") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        return float(value) if value % 1 else int(value)
    if isinstance(value, float):
        return round(value, 6)
    return value


def rows_of(columns, rows) -> tuple[list[str], list[str]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr([_plain(r[i]) for i in order]) for r in rows)


def compare(spark, con, sf_dir, query, sql) -> tuple[bool, str]:
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return True, f"{len(got[1])} rows, no SQL"
    answer = con.execute(sql)
    want = rows_of([d[0] for d in answer.description], answer.fetchall())
    if got == want:
        return True, f"{len(got[1])} rows"
    if got[0] != want[0]:
        return False, f"columns {got[0]} / {want[0]}"
    extra = sorted(set(got[1]) - set(want[1]))
    lacking = sorted(set(want[1]) - set(got[1]))
    return False, f"{len(got[1])}/{len(want[1])} rows\n   spark {extra[:2]}\n   sql   {lacking[:2]}"


def main(sf_dir: str, names: list[str]) -> int:
    from checks.oracle import ORACLE
    from checks.queries import QUERIES

    spark, con, bad = session(), duck(sf_dir), 0
    spark.sparkContext.setLogLevel("ERROR")
    for name, query in QUERIES.items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            ok, note = compare(spark, con, sf_dir, query, ORACLE.get(name))
        except Exception as problem:  # report and go on with the next query
            ok, note = False, f"{type(problem).__name__}: {str(problem)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.2f}s {note}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
