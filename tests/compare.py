"""Hold queries against their SQL in DuckDB: python tests/compare.py SF_DIR [NAME...]"""

import collections
import os
import sys

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return collections.Counter(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in data)


def differs(spark, c, query, sql, sf_dir):
    df = query(spark, sf_dir)
    mine = rows(df.columns, df.collect())
    r = c.execute(sql)
    cols = [d[0] for d in r.description]
    theirs = rows(cols, r.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} {sorted(cols)}"
    if mine != theirs:
        return f"{sum(mine.values())} and {sum(theirs.values())} rows; only mine {list((mine - theirs).items())[:2]}; only SQL {list((theirs - mine).items())[:2]}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    s = SparkSession.builder.master("local[8]").config(map={"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}).getOrCreate()
    s.sparkContext.setLogLevel("OFF")
    con, q = duck(sys.argv[1]), e.queries()
    for name, sql in e.oracle_sql().items():
        if len(sys.argv) < 3 or name in sys.argv[2:]:
            try:
                print(name, (differs(s, con, q[name], sql, sys.argv[1]) or "ok")[:600], flush=True)
            except Exception as x:
                print(name, "ERROR", str(x)[:400].replace("\n", " "), flush=True)
