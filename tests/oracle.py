"""Run a registered query and its SQL twin on the same files, and compare."""

from __future__ import annotations

import math
import sys
import time
import traceback

import duckdb
import numpy as np

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(_plain(v) for v in value)
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def _kinds(columns, types):
    return {c: t for c, t in zip(columns, types)}


SAME_TYPE = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "array<int>": "INTEGER[]",
    "array<string>": "VARCHAR[]",
}


def compare(spark, name: str, folder: str) -> str | None:
    """None when both agree, else what differs."""
    from kindstore.catalog import ORACLES, QUERIES

    df = QUERIES[name](spark, folder)
    mine = _rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        return None if mine else "no rows"
    con = connect(folder)
    relation = con.sql(ORACLES[name])
    if sorted(relation.columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(relation.columns)}"
    sql_types = dict(zip(relation.columns, map(str, relation.types)))
    wrong = {c: (t, sql_types[c]) for c, t in df.dtypes if SAME_TYPE.get(t) != sql_types[c]}
    theirs = _rows(relation.columns, relation.fetchall())
    if wrong:
        return f"types {wrong}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b:
            bad = sum(x != y for x, y in zip(mine, theirs))
            return f"{bad} rows differ, first: {str(a)[:400]} != {str(b)[:400]}"
    return None if mine else "no rows"


def main(names: list[str]) -> int:
    from kindstore.catalog import ORACLES, QUERIES
    from kindstore.session import local_session

    folder = "/root/testdata/sf0.01"
    if names and names[0].startswith("sf"):
        folder = f"/root/testdata/{names.pop(0)}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    failures = 0
    for name in names or QUERIES:
        start = time.time()
        try:
            problem = compare(spark, name, folder)
        except Exception as error:  # noqa: BLE001
            text = str(error)
            problem = f"{type(error).__name__}: {text[:600].splitlines()}"
            if "-v" in sys.argv:
                traceback.print_exc()
        kind = "sql " if name in ORACLES else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
        failures += problem is not None
    return failures


if __name__ == "__main__":
    sys.exit(main([a for a in sys.argv[1:] if a != "-v"]))
