"""Run a suite query and its checking SQL side by side."""

import glob
import os
import sys
import time

import pandas as pd


def connect(sf_dir):
    try:
        import duckdb
    except ImportError:  # kept apart from the main environment
        sys.path.append("/opt/oracle")
        import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(df):
    df = df[sorted(df.columns)]
    out = df.astype(object).where(df.notna(), None)
    rows = [
        tuple(int(v) if isinstance(v, (int, bool)) else v if v is None else str(v) for v in r)
        for r in out.itertuples(index=False)
    ]
    return sorted(rows, key=repr)


def compare(spark, con, name, run, sql, sf_dir):
    t = time.time()
    got = run(spark, sf_dir).toPandas()
    took = time.time() - t
    t = time.time()
    want = con.execute(sql).fetchdf() if sql else None
    other = time.time() - t
    if want is None:
        return len(got) > 0, f"{len(got)} rows, no SQL", took
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(got.columns)} / {sorted(want.columns)}", took
    a, b = normal(got), normal(want)
    if a != b:
        extra = sorted(set(a) - set(b), key=repr)[:2], sorted(set(b) - set(a), key=repr)[:2]
        return False, f"{len(a)} / {len(b)} rows, e.g. {str(extra)[:1500]}", took
    kinds = {c: (str(got[c].dtype), str(want[c].dtype)) for c in got.columns if str(got[c].dtype) != str(want[c].dtype)}
    return True, f"{len(a)} rows, sql {other:.2f}s {kinds or ''}", took


if __name__ == "__main__":
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sys.path.insert(0, root)
    import __spark_entry__ as entry
    from notelake.session import builder

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = (
        builder().master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        try:
            ok, note, took = compare(spark, con, name, run, sqls.get(name), sf_dir)
        except Exception as e:  # report and go on
            ok, note, took = False, f"{type(e).__name__}: {str(e)[:600]}", 0
        print("ok  " if ok else "FAIL", name, f"{took:.2f}s", note, flush=True)
