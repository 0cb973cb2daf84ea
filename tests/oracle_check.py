"""Compare every query with its SQL: python tests/oracle_check.py [sf_dir] [query ...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _cell(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        number = float(value)
        return (0, "") if math.isnan(number) else (2, f"{number:.9g}")
    return (3, str(value))


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, con, sf: str, name: str) -> tuple[bool, str]:
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, sf)
    mine = rows_of(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return bool(mine), f"{len(mine)} rows, no SQL"
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    theirs = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(columns)}"
    if mine == theirs and mine:
        return True, f"{len(mine)} rows"
    left, right = set(mine), set(theirs)
    only_mine, only_theirs = [r for r in mine if r not in right], [r for r in theirs if r not in left]
    return False, f"{len(mine)} vs {len(theirs)} rows\n  spark {only_mine[:2]}\n  sql   {only_theirs[:2]}"


def main() -> int:
    import __spark_entry__ as entry
    from foliomill.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark, con, bad = local_session("check", 8), connect(sf), []
    for name in names:
        start = time.time()
        try:
            ok, note = compare(spark, con, sf, name)
        except Exception as exc:  # noqa: BLE001 - report and go on with the next query
            ok, note = False, str(exc)[:700]
        if not ok:
            bad.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{len(names) - len(bad)} of {len(names)} agree; failing: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
