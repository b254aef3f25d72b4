"""Side by side comparison of a registered query with its checking statement."""

from __future__ import annotations

import math

from edurank.workload.registry import REGISTRY, run

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for table in TABLES:
        con.execute(f"create view {table} as select * from read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return format(float(value), ".9g")
    return str(value)


def _kind(value) -> str:
    return type(value).__name__


def normalized(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, con, name: str, sf_dir: str) -> dict:
    """Row counts, column names, value types and values of both sides."""
    df = run(name, spark, sf_dir)
    spark_rows = [tuple(r) for r in df.collect()]
    oracle = REGISTRY[name].oracle
    if oracle is None:
        return {"name": name, "rows": len(spark_rows), "ok": True, "note": "rows only"}
    cursor = con.execute(oracle)
    columns = [d[0] for d in cursor.description]
    rows = cursor.fetchall()
    note = ""
    if sorted(columns) != sorted(df.columns):
        note = f"columns {sorted(set(columns) ^ set(df.columns))}"
    else:
        left, right = normalized(df.columns, spark_rows), normalized(columns, rows)
        if left != right:
            only_left = sorted(set(left) - set(right))[:2]
            only_right = sorted(set(right) - set(left))[:2]
            note = f"values differ: {sorted(df.columns)} spark={only_left} oracle={only_right}"
        else:
            kinds = _type_difference(df.columns, spark_rows, columns, rows)
            note = f"types {kinds}" if kinds else ""
    return {"name": name, "rows": len(spark_rows), "oracle_rows": len(rows), "ok": not note, "note": note}


def _type_difference(left_columns, left_rows, right_columns, right_rows) -> list[str]:
    def kinds(columns, rows):
        found = {}
        for i, column in enumerate(columns):
            found[column] = next((_kind(r[i]) for r in rows if r[i] is not None), None)
        return found

    left, right = kinds(left_columns, left_rows), kinds(right_columns, right_rows)
    return [f"{c}: {left[c]} / {right[c]}" for c in left if left[c] != right[c]]
