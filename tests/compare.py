"""Runs registered queries against their SQL in DuckDB: python tests/compare.py [sf] [name ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session() -> SparkSession:
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    def one(v):
        if isinstance(v, float):
            return "null" if v != v else f"{v:.9g}"
        if v is None or v is pd.NaT or v is pd.NA:
            return "null"
        if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
            return "[" + ",".join(one(x) for x in v) + "]"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if hasattr(v, "item"):
            return one(v.item())
        return str(v)
    out = df.astype(object).map(one)
    out = out.map(lambda s: s[:-2] if s.endswith(".0") and s[:-2].lstrip("-").isdigit() else s)
    return out.sort_values(list(out.columns)).reset_index(drop=True) if len(out.columns) else out


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> str:
    began = time.time()
    df = query(spark, sf_dir)
    a = pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns)
    mid = time.time()
    rel = con.sql(sql)
    b = pd.DataFrame(rel.fetchall(), columns=rel.columns)
    took = f"spark {mid - began:.1f}s sql {time.time() - mid:.1f}s"
    if sorted(a.columns) != sorted(b.columns):
        return f"{name}: columns {sorted(a.columns)} against {sorted(b.columns)}"
    x, y = canon(a), canon(b)
    if len(x) != len(y):
        extra = pd.concat([x.assign(side="spark"), y.assign(side="sql")]).drop_duplicates(list(x.columns), keep=False)
        return f"{name}: {len(x)} rows against {len(y)}\n{extra.head(6).to_string(max_colwidth=60)}"
    bad = (x != y).any(axis=1)
    if bad.any():
        i = bad[bad].index[:3]
        return f"{name}: {bad.sum()} of {len(x)} rows differ\n{x.loc[i].to_string(max_colwidth=60)}\n{y.loc[i].to_string(max_colwidth=60)}"
    return f"{name}: ok, {len(x)} rows, {took}"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark, con = session(), database(f"/root/testdata/{sf}")
    queries, sqls = entry.queries(), entry.oracle_sql()
    for name in names:
        try:
            if name in sqls:
                print(compare(spark, con, name, queries[name], sqls[name], f"/root/testdata/{sf}"), flush=True)
            else:
                t = time.time()
                print(f"{name}: {queries[name](spark, f'/root/testdata/{sf}').count()} rows, no sql, {time.time() - t:.1f}s", flush=True)
        except Exception as e:
            print(f"{name}: FAILED {type(e).__name__} {str(e)[:1500]}", flush=True)
