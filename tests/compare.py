"""Runs registered queries next to their SQL in DuckDB and compares rows, names and types.

    python tests/compare.py [sf_dir] [key ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def family(type_name: str) -> str:
    t = type_name.lower()
    for names, out in ((("bigint", "int64"), "bigint"), (("integer", "int32", "int"), "int"),
                       (("double", "float64"), "double"), (("varchar", "string"), "string"),
                       (("boolean", "bool"), "bool")):
        if t in names:
            return out
    return t


def compare(spark, con, sf_dir: str, key: str, fn, sql: str | None) -> str:
    df = fn(spark, sf_dir)
    names = sorted(df.columns)
    rows = [tuple(r[c] for c in names) for r in df.collect()]
    if not sql:
        return f"rows-only {len(rows)}"
    rel = con.sql(sql)
    duck_types = dict(zip(rel.columns, map(str, rel.types)))
    if sorted(rel.columns) != names:
        raise AssertionError(f"{key}: columns {names} vs {sorted(rel.columns)}")
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema}
    for c in names:
        if family(spark_types[c]) != family(duck_types[c]):
            raise AssertionError(f"{key}: type of {c}: {spark_types[c]} vs {duck_types[c]}")
    at = [rel.columns.index(c) for c in names]
    want = [tuple(r[i] for i in at) for r in rel.fetchall()]
    if len(rows) != len(want):
        raise AssertionError(f"{key}: {len(rows)} rows vs {len(want)}")
    clean = lambda rs: sorted(tuple(map(repr, r)) for r in rs)
    got, exp = clean(rows), clean(want)
    if got != exp:
        miss = [r for r in got if r not in set(exp)][:3]
        lack = [r for r in exp if r not in set(got)][:3]
        raise AssertionError(f"{key}: values differ\n  spark {str(miss)[:1500]}\n  duck  {str(lack)[:1500]}")
    return f"equal {len(rows)}"


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from tessera.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("compare", "local[8]", 8, spark__driver__memory="12g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("OFF")
    con = duck(sf_dir)
    sqls, bad = oracle_sql(), []
    for key, fn in queries().items():
        if wanted and not any(key == w or (w.endswith("*") and key.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            print(f"{key:32s} {compare(spark, con, sf_dir, key, fn, sqls.get(key))}  {time.time() - start:.1f}s",
                  flush=True)
        except Exception as e:  # noqa: BLE001
            bad.append(key)
            print(f"{key:32s} FAIL {str(e)[:2500] if isinstance(e, AssertionError) else str(e)[:500]}", flush=True)
    print("failed:", bad)
