"""Run registered queries beside their SQL and report differences.

    python -m checks.compare [folder] [name ...]
"""

import os
import sys
import time

import duckdb

from vectormart.session import make_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else value + 0.0
    return value


def ordered(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    table = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(names), sorted(table, key=lambda row: tuple((v is None, type(v).__name__, str(v)) for v in row))


def kinds(rows):
    return [sorted({type(v).__name__ for v in column if v is not None}) for column in zip(*rows)]


def difference(spark_rows, spark_names, sql_rows, sql_names):
    """First difference as text, or None."""
    a_names, a = ordered(spark_names, spark_rows)
    b_names, b = ordered(sql_names, sql_rows)
    if a_names != b_names:
        return f"columns {a_names} / {b_names}"
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}"
    if kinds(a) != kinds(b):
        return f"types {dict(zip(a_names, kinds(a)))} / {dict(zip(b_names, kinds(b)))}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(wrong)} rows differ, e.g. {wrong[0]}" if wrong else None


def check(spark, con, sf_dir, name):
    """Difference (or None), number of rows, seconds of the query."""
    from checks import QUERIES, SQL

    started = time.time()
    df = QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    seconds = time.time() - started
    if name not in SQL:
        return None, len(rows), seconds
    result = con.execute(SQL[name])
    return difference(rows, df.columns, result.fetchall(), [d[0] for d in result.description]), len(rows), seconds


def main():
    from checks import QUERIES, SQL

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = make_session(master=f"local[{os.environ.get('BENCH_CPUS', '8')}]", settings={
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        try:
            problem, rows, seconds = check(spark, con, sf_dir, name)
        except Exception as error:
            problem, rows, seconds = f"{type(error).__name__}: {str(error)[:700]}", -1, 0.0
        bad += problem is not None
        mark = "FAIL" if problem else ("ok" if name in SQL else "ok (rows only)")
        print(f"{mark:15} {name:26} {rows:8} rows {seconds:6.2f}s {problem or ''}"[:1200], flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
