"""Run registered queries beside their SQL and compare rows, columns and values."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(r[n] for n in names) for r in df.select(*[f"`{n}`" for n in names]).collect())


def sql_rows(con, sql: str) -> tuple[list[str], Counter]:
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(r[i] for i in order) for r in cur.fetchall())


def compare(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty when equal, else what differs."""
    names, rows = spark_rows(query(spark, sf_dir))
    want_names, want = sql_rows(con, sql)
    if names != want_names:
        return f"columns {names} != {want_names}"
    if rows != want:
        extra, missing = rows - want, want - rows
        return (f"{sum(rows.values())} rows vs {sum(want.values())}; extra {list(extra.items())[:2]}; "
                f"missing {list(missing.items())[:2]}")
    kinds = [{type(r[i]) for r in rows if r[i] is not None} for i in range(len(names))]
    wanted = [{type(r[i]) for r in want if r[i] is not None} for i in range(len(names))]
    return "" if kinds == wanted else f"types {kinds} != {wanted}"


def main() -> None:
    import __spark_entry__ as entry
    from jobscope.session import build_session

    sf_dir, only = sys.argv[1], set(sys.argv[2:])
    spark = build_session("compare", "local[8]", 8, "12g")
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = duck(sf_dir), entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            if name in sqls:
                result = compare(spark, con, query, sqls[name], sf_dir)
                note = "ok" if not result else f"DIFF {result}"
            else:
                note = f"rows only: {query(spark, sf_dir).count()}"
        except Exception as error:  # noqa: BLE001
            note = f"ERROR {str(error)[:1500]}"
        bad += note.startswith(("DIFF", "ERROR"))
        print(f"{name:35s} {time.time() - start:6.2f}s {note[:1800]}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
