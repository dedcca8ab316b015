"""Results of queries against those of their SQL in DuckDB: python tests/compare.py SF_DIR [NAME...]"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time
from collections import Counter


def plain(x):
    if isinstance(x, decimal.Decimal):
        return int(x) if x == x.to_integral_value() else float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


def connect(sf_dir: str):
    import duckdb

    db = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{name}") else "")
        db.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
    return db


def differences(df, db, sql: str) -> str:
    """What differs between a DataFrame's rows and those of the SQL; empty if nothing does."""
    cur = db.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = sorted(names)
    want = Counter(tuple(plain(r[names.index(c)]) for c in order) for r in cur.fetchall())
    found = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    if want == found:
        return ""
    return f"{sum(found.values())} rows against {sum(want.values())}; only here {list((found - want).items())[:2]}; only in SQL {list((want - found).items())[:2]}"[:1500]


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    cpus = os.environ.get("CPUS", "4")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    import __spark_entry__ as entry

    sf, queries, oracles = sys.argv[1], entry.queries(), entry.oracle_sql()
    db, bad = connect(sf), 0
    for name in sys.argv[2:] or queries:
        began = time.time()
        try:
            said = differences(queries[name](spark, sf), db, oracles[name]) if name in oracles else f"({queries[name](spark, sf).count()} rows, no SQL)"
        except Exception as e:  # noqa: BLE001
            said = f"ERROR {type(e).__name__} {str(e)[:700]}"
        bad += bool(said) and not said.startswith("(")
        if said or len(sys.argv) > 2:
            print(name, f"{time.time() - began:.1f}s", said or "ok", flush=True)
    print("differ:", bad)
