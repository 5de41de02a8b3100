"""Compare registered queries with their SQL: `python scripts/check.py [sf] [name part …]`."""

from __future__ import annotations

import os
import sys
import time
import traceback

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from workload import ORACLES, QUERIES  # noqa: E402
from workload.base import SCHEMA  # noqa: E402

DATA = "/root/testdata"


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("tallyglass-check")
        .config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in SCHEMA:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def canonical(value):
    if value is None:
        return ("", "")
    if isinstance(value, bool):
        return ("b", str(value))
    if hasattr(value, "isoformat"):
        return ("t", value.isoformat(sep=" ") if hasattr(value, "hour") else value.isoformat())
    if isinstance(value, (list, tuple)):
        return ("l", str([canonical(v) for v in value]))
    if isinstance(value, str):
        return ("s", value)
    if isinstance(value, int):
        return ("n", str(value))
    text = f"{float(value):.9g}"
    return ("n", str(int(float(text))) if float(text).is_integer() and abs(float(text)) < 1e15
            else text)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def type_gaps(df, cursor) -> list[str]:
    """Columns whose types differ between the engines, so that hashes of values might."""
    names = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
             "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz"}
    spark_types = dict(df.dtypes)
    gaps = []
    for name, kind, *_ in cursor.description:
        sql, own = str(kind), spark_types.get(name)
        if sql.startswith("DECIMAL"):
            same = own.startswith("decimal") and own.split(",")[1] == sql.lower().split(",")[1]
        else:
            same = names.get(sql) == own
        if not same:
            gaps.append(f"{name}: {own} / {sql}")
    return gaps


def compare(spark, con, name, sf_dir):
    """(rows, problem or None, seconds)."""
    start = time.time()
    df = QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if name not in ORACLES:
        return len(rows), None, took
    cursor = con.execute(ORACLES[name])
    expected_columns = [d[0] for d in cursor.description]
    got = normal(df.columns, rows)
    want = normal(expected_columns, cursor.fetchall())
    if got[0] != want[0]:
        return len(rows), f"columns {got[0]} != {want[0]}", took
    gaps = type_gaps(df, cursor)
    if gaps:
        print(f"     {name}: types differ: {', '.join(gaps)}", flush=True)
    if got[1] != want[1]:
        missing = [r for r in want[1] if r not in got[1]][:3]
        extra = [r for r in got[1] if r not in want[1]][:3]
        return len(rows), (f"{len(got[1])} vs {len(want[1])} rows;\n   spark {extra}\n"
                           f"   sql   {missing}"), took
    return len(rows), None, took


if __name__ == "__main__":
    scale = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    wanted = sys.argv[2:]
    folder = f"{DATA}/sf{scale}"
    spark, con = session(), duck(folder)
    failures = 0
    for name in QUERIES:
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            n, problem, took = compare(spark, con, name, folder)
        except Exception as error:  # noqa: BLE001
            n, took = -1, 0
            text = str(error)
            problem = text[:700] if len(wanted) != 1 else "".join(traceback.format_exc())[-3000:]
        state = "ok" if problem is None else "FAIL"
        mark = "" if name in ORACLES else " (no sql)"
        print(f"{state:5}{name:40} rows={n:<7} {took:6.2f}s{mark}"
              + ("" if problem is None else f"\n   {problem}"), flush=True)
        failures += problem is not None
    print("failures:", failures)
    sys.exit(bool(failures))
