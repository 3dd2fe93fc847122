"""Hold every query with SQL against DuckDB: python -m tests.compare [sf_dir] [name ...]."""

from __future__ import annotations

import os
import sys
import time


def rows_of(rows, names):
    at = sorted(range(len(names)), key=lambda i: names[i])
    out = []
    for r in rows:
        out.append(tuple(round(x, 6) + 0.0 if isinstance(x, float) else str(x) if x is not None and not isinstance(x, (int, bool)) else x for x in (r[i] for i in at)))
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)), sorted(names)


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            con.sql(f"create view {f[:-8]} as select * from '{sf_dir}/{f}'")
    return con


def differs(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got, names = rows_of([tuple(r) for r in df.collect()], df.columns)
    rel = con.sql(sql)
    want, wnames = rows_of(rel.fetchall(), rel.columns)
    if names != wnames:
        return f"columns {names} {wnames}"
    if got != want:
        a, b = [x for x in got if x not in set(want)][:2], [x for x in want if x not in set(got)][:2]
        return f"{len(got)} and {len(want)} rows; {a} {b}"[:700]
    return None if got else "no rows"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    from convmatch.plans import registry

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    for name, q in registry.QUERIES.items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        t0 = time.time()
        try:
            if name in registry.ORACLE_SQL:
                why = differs(spark, con, q, registry.ORACLE_SQL[name], sf)
            else:
                n = q(spark, sf).count()
                why = None if n else "no rows"
        except Exception as e:
            why = "error " + str(e)[:600]
        print("ok " if why is None else "BAD", name, round(time.time() - t0, 1), why or "", flush=True)
