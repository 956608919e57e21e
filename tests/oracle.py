"""Queries of the entry module against their SQL in DuckDB: python tests/oracle.py SF_DIR [NAME...]."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted((repr(tuple(plain(r[i]) for i in order)) for r in data))


def compare(spark, sf_dir, name):
    """None if equal, else what differs."""
    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = e.queries()[name](spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(e.oracle_sql()[name])
    want = rows([c[0] for c in cur.description], cur.fetchall())
    if got == want:
        return None
    odd = [(a, b) for a, b in zip(got[1], want[1]) if a != b][:3]
    return f"columns {got[0]} / {want[0]}; rows {len(got[1])} / {len(want[1])}; {odd}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in sys.argv[2:] or e.oracle_sql():
        t = time.time()
        try:
            what = compare(spark, sys.argv[1], name)
        except Exception as x:
            what = f"{type(x).__name__}: {str(x)[:1500]}"
        bad += bool(what)
        print(name, "ok" if not what else f"DIFFERS: {what}", round(time.time() - t, 1), flush=True)
    sys.exit(bad > 0)
