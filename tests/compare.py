"""Run registered queries next to their SQL and compare whole results.

    python tests/compare.py [folder of tables] [query ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, rows in total order, floats as they are."""
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object or str(df[c].dtype) in ("str", "string"):
            df[c] = df[c].astype(object).where(df[c].notna(), "<null>").astype(str)
        elif str(df[c].dtype) not in ("bool", "float64"):
            df[c] = df[c].astype("float64") if df[c].isna().any() else df[c].astype("int64")
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def difference(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str | None:
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(sql_df.columns)}"
    if len(spark_df) != len(sql_df):
        return f"rows {len(spark_df)} vs {len(sql_df)}"
    left, right = canonical(spark_df), canonical(sql_df)
    for c in left.columns:
        same = (left[c] == right[c]) | (left[c].isna() & right[c].isna())
        if not same.all():
            at = same.idxmin()
            return f"{c}: {(~same).sum()} rows, first\n{left.loc[at].to_dict()}\n{right.loc[at].to_dict()}"
    return None


def types_of(spark_schema, relation) -> list[str]:
    """Columns whose types differ between the two engines."""
    known = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    theirs = dict(zip(relation.columns, map(str, relation.types)))
    return [
        f"{f.name}: {f.dataType.simpleString()} vs {theirs.get(f.name)}"
        for f in spark_schema.fields if known.get(f.dataType.simpleString()) != theirs.get(f.name)
    ]


def main(folder: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from notarium.session import local_session

    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.conf.set("spark.sql.maxPlanStringLength", "2000")
    con, queries, oracle, bad = duck(folder), entry.queries(), entry.oracle_sql(), 0
    for name in names or queries:
        try:
            begin = time.time()
            result = queries[name](spark, folder)
            got = result.toPandas()
            took = time.time() - begin
            relation = con.sql(oracle[name])
            problem = difference(got, relation.df()) or "; ".join(types_of(result.schema, relation)) or None
            sql_took = time.time() - begin - took
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            problem, took, got, sql_took = f"{type(error).__name__}: {str(error)[:600]}", 0.0, [], 0.0
        bad += problem is not None
        print(f"RES {name:20s} {len(got):9d} rows {took:7.2f}s sql {sql_took:6.2f}s {problem or 'ok'}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001", sys.argv[2:])))
