"""Runs queries and their DuckDB SQL side by side: python tests/oracle.py DIR [NAME...]"""

from __future__ import annotations

import datetime
import decimal
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame) -> list[tuple]:
    """Sorted rows, columns by name."""
    names = sorted(frame.columns)
    plain = lambda v: float(v) if isinstance(v, decimal.Decimal) else v.isoformat() if isinstance(v, datetime.datetime) else v
    return sorted((tuple(plain(r[n]) for n in names) for r in frame.collect()), key=repr)


def duck(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: float(v) if isinstance(v, decimal.Decimal) else v
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)


def compare(spark, sf_dir: str, name: str) -> str:
    import __spark_entry__ as e

    frame = e.queries()[name](spark, sf_dir)
    own = rows_of(frame)
    sql = e.oracle_sql().get(name)
    if sql is None:
        return f"{len(own)} rows, no oracle"
    names, want = duck(sf_dir, sql)
    if names != sorted(frame.columns):
        return f"columns differ: {sorted(frame.columns)} and {names}"
    if own != want:
        odd = [x for x in own if x not in set(want)][:2], [x for x in want if x not in set(own)][:2]
        return f"rows differ: {len(own)} and {len(want)}: {odd}"
    return f"{len(own)} rows, equal"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    session = SparkSession.builder.master("local[6]").config("spark.sql.shuffle.partitions", "6").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    for n in sys.argv[2:] or [n for n in e.queries() if not n.startswith("op") and n != "pipeline"]:
        start = time.time()
        try:
            said = compare(session, sys.argv[1], n)
        except Exception as error:  # each query is reported
            said = f"{type(error).__name__}: {str(error)[:700]}"
        print(f"{n}: {said} ({time.time() - start:.1f} s)", flush=True)
