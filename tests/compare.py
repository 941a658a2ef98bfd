"""Run registered queries next to their SQL twins in DuckDB.

``python tests/compare.py [--sf DIR] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(row[i]) for i in order) for row in data), key=repr)


def compare(spark, con, name: str, sf_dir: str, queries, oracles) -> tuple[bool, str]:
    start = time.time()
    df = queries[name](spark, sf_dir)
    got = df.collect()
    spent = time.time() - start
    if name not in oracles:
        return len(got) > 0, f"rows only: {len(got)} rows, {spent:.1f}s"
    start = time.time()
    cur = con.execute(oracles[name])
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    duck_spent = time.time() - start
    info = f"{len(got)} rows, {spent:.1f}s (sql {duck_spent:.1f}s)"
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(cols)}"
    a, b = _rows(df.columns, got), _rows(cols, want)
    if a != b:
        only_a = [x for x in a if x not in set(b)][:2] if len(a) < 200000 else []
        only_b = [x for x in b if x not in set(a)][:2] if len(b) < 200000 else []
        return False, f"{info} want {len(want)}\n   spark {str(only_a)[:700]}\n   sql   {str(only_b)[:700]}"
    types = dict(df.dtypes)
    narrow = [c for c, t in types.items() if t in ("int", "smallint", "tinyint", "float")]
    return len(got) > 0, info + (f" NARROW {narrow}" if narrow else "")


def main(argv: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        del argv[i : i + 2]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    con = duck(sf)
    names = argv or list(queries)
    bad = 0
    for name in names:
        try:
            ok, info = compare(spark, con, name, sf, queries, oracles)
        except Exception as e:  # noqa: BLE001
            ok, info = False, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print(("ok  " if ok else "BAD ") + name + ": " + info, flush=True)
    print(f"{len(names) - bad} of {len(names)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
