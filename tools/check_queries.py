"""Run queries against their SQL in DuckDB: columns, types, row counts and values.

usage: check_queries.py FOLDER [NAME ...]
CHECK_CONF holds further session settings, such as "spark.sql.session.timeZone=Asia/Tokyo".
"""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from areapanel.catalog import QUERIES, SQL  # noqa: E402
from areapanel.session import build_session  # noqa: E402

CONF = dict(pair.split("=", 1) for pair in os.environ.get("CHECK_CONF", "").split() if pair)
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return 0.0 if v == 0 and isinstance(v, float) else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql) -> tuple[list[str], int]:
    rel = con.sql(sql)
    problems = []
    mine, theirs = dict(df.dtypes), {c: str(t) for c, t in zip(rel.columns, rel.types)}
    if set(mine) != set(theirs):
        return [f"columns {sorted(set(mine) ^ set(theirs))}"], 0
    problems += [f"type {c}: {mine[c]} / {theirs[c]}" for c in mine if TYPES.get(mine[c]) != theirs[c]]
    a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    b = rows_of(rel.columns, rel.fetchall())
    if len(a) != len(b):
        problems.append(f"rows {len(a)} / {len(b)}")
    elif a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        problems.append(f"{len(bad)} values differ, first {bad[0]}")
    return problems, len(a)


def main() -> None:
    folder, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = build_session("check", "local[8]", {
        "spark.driver.memory": "8g", "spark.sql.shuffle.partitions": "8", "spark.ui.showConsoleProgress": "false", **CONF})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, folder)
            if name in SQL:
                problems, n = compare(df, con, SQL[name])
            else:
                n, problems = df.count(), []
        except Exception as error:  # report and go on with the next query
            problems, n = [f"{type(error).__name__}: {str(error)[:1500]}"], "-"
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name:24s} rows={n} {time.time() - start:.2f}s", *problems, flush=True)
    print(f"{len(names)} queries, {failed} failed")


if __name__ == "__main__":
    main()
