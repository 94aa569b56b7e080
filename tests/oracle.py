"""Runs a query in Spark and its SQL in DuckDB and compares the rows."""

import datetime
import math
import sys
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p if p.is_file() else p / '*.parquet'}')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, bool) or x is None or isinstance(x, (str, datetime.date)):
        return x
    return float(x)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(x[i]) for i in order) for x in data)


def compare(spark, con, name, f, sql, sf_dir):
    df = f(spark, sf_dir)
    got = rows(df.columns, df.collect())
    if sql is None:
        return f"{sum(got.values())} rows" if got else "NO ROWS"
    rel = con.sql(sql)
    want = rows(rel.columns, rel.fetchall())
    assert sorted(df.columns) == sorted(rel.columns), (name, df.columns, rel.columns)
    if got != want:
        a, b = got - want, want - got
        return f"DIFFER {sum(got.values())} {sum(want.values())}, only here {sum(a.values())}: {list(a)[:2]}, only there: {list(b)[:2]}"
    return "same"


if __name__ == "__main__":
    import os

    repo = str(Path(__file__).resolve().parents[1])
    sys.path.insert(0, repo)
    os.environ["PYTHONPATH"] = repo
    from pyspark.sql import SparkSession

    from waystone.plans.queries import ORACLES, QUERIES

    spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    sf, only = sys.argv[1], sys.argv[2:]
    con = connect(sf)
    for name, f in QUERIES.items():
        if not only or name in only:
            try:
                said = compare(spark, con, name, f, ORACLES.get(name), sf)
            except Exception as e:  # noqa: BLE001
                said = f"ERROR {type(e).__name__} {str(e)[:400]}"
            if said != "same" or only:
                print(name, said, flush=True)
    print("done", len(QUERIES), len(ORACLES))
