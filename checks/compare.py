"""Run checks against DuckDB: `python -m checks.compare FOLDER [name ...]`."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from checks import all_checks
from checks.tables import BASE


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in sorted(BASE):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _cell(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return str([_cell(x) for x in v])
    if isinstance(v, bool):
        return str(v)
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return f"{v:.9g}" if not v.is_integer() else str(int(v))
    return str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([tuple(_cell(r[i]) for i in order) for r in rows])


def compare(spark, con, name: str, folder: str) -> tuple[bool, str]:
    queries, oracles = all_checks()
    t0 = time.time()
    df = queries[name](spark, folder)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t0
    if name not in oracles:
        return bool(got[1]), f"{name}: {len(got[1])} rows, no SQL ({took:.1f} s)"
    t0 = time.time()
    cur = con.execute(oracles[name])
    want = _rows([d[0] for d in cur.description], cur.fetchall())
    sql_took = time.time() - t0
    if got == want:
        return bool(got[1]), f"{name}: {len(got[1])} rows equal ({took:.1f} s, SQL {sql_took:.1f} s)"
    note = f"{name}: DIFFERS {got[0]} {len(got[1])} rows, SQL {want[0]} {len(want[1])} rows ({took:.1f} s)"
    only = [r for r in got[1] if r not in set(want[1])][:2], [r for r in want[1] if r not in set(got[1])][:2]
    return False, f"{note}\n  spark: {str(only[0])[:900]}\n  sql:   {str(only[1])[:900]}"


def main() -> None:
    from sparkdocs.session import build_session

    folder, names = sys.argv[1], sys.argv[2:]
    spark = build_session(
        "checks", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = []
    for name in names or sorted(all_checks()[0]):
        try:
            ok, text = compare(spark, con, name, folder)
        except Exception as e:
            ok, text = False, f"{name}: ERROR {str(e)[:1200]}"
        print(("ok   " if ok else "FAIL ") + text, flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)


if __name__ == "__main__":
    main()
