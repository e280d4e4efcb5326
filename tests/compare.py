"""Run queries in both engines and compare the rows as multisets."""

import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if value is None or isinstance(value, (str, bool)):
        return value
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(cell(r[i]) for i in order) for r in rows)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    return rows_of(names, result.fetchall())


def difference(spark_side, duck_side):
    """None when equal, else a short text."""
    if spark_side[0] != duck_side[0]:
        return f"columns {spark_side[0]} / {duck_side[0]}"
    left, right = spark_side[1] - duck_side[1], duck_side[1] - spark_side[1]
    if not left and not right:
        return None
    return f"{sum(left.values())} / {sum(right.values())} rows differ\n  spark {list(left)[:2]}\n  duck  {list(right)[:2]}"


def main(sf, *chosen):
    import __spark_entry__ as E
    from mailtables.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    sql = E.oracle_sql()
    bad = 0
    for name, fn in E.queries().items():
        if chosen and name not in chosen:
            continue
        try:
            t0 = time.time()
            ours = spark_rows(fn(spark, sf_dir))
            t1 = time.time()
            n = sum(ours[1].values())
            if name not in sql:
                print(f"{name:28s} rows {n:6d} spark {t1 - t0:6.2f}s  no SQL", flush=True)
                continue
            theirs = duck_rows(con, sql[name])
            gap = difference(ours, theirs)
            bad += gap is not None
            print(f"{name:28s} rows {n:6d} spark {t1 - t0:6.2f}s duck {time.time() - t1:6.2f}s  {'ok' if gap is None else gap[:1500]}", flush=True)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"{name:28s} ERROR {type(e).__name__} {str(e)[:800]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(*sys.argv[1:])
