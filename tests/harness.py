"""Run registered queries in Spark and in DuckDB on the same tables and compare them."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

SF = os.environ.get("TIDEMARK_SF", "/root/testdata/sf0.01")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf: str = SF):
    con = duckdb.connect()
    con.execute("SET threads TO 4")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def _cell(value):
    if value is None:
        return "\0null"
    if isinstance(value, float):
        return "\0nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return f"{type(value).__name__}:{value}"


def _family(text: str) -> str:
    text = text.lower()
    for family, names in {
        "int": ("bigint", "long"),
        "int32": ("int", "integer"),
        "float": ("double", "float"),
        "text": ("string", "varchar"),
        "bool": ("boolean",),
    }.items():
        if text in names:
            return family
    return text


def compare(spark, key: str, sf: str = SF, con=None) -> tuple[bool, str]:
    import __spark_entry__ as entry

    started = time.time()
    frame = entry.queries()[key](spark, sf)
    names = sorted(frame.columns)
    types = {f.name: _family(f.dataType.simpleString()) for f in frame.schema}
    rows = sorted(tuple(_cell(r[n]) for n in names) for r in frame.collect())
    spent = time.time() - started
    sql = entry.oracle_sql().get(key)
    if sql is None:
        return True, f"rows={len(rows)} rows-only {spent:.1f}s"
    cur = (con or connect(sf)).execute(sql)
    cols = [d[0] for d in cur.description]
    want_types = {d[0]: _family(str(d[1])) for d in cur.description}
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    if sorted(cols) != names:
        return False, f"columns {names} != {sorted(cols)}"
    want = sorted(tuple(_cell(r[i]) for i in order) for r in cur.fetchall())
    if want_types != types:
        diff = {n: (types[n], want_types[n]) for n in names if types[n] != want_types[n]}
        return False, f"types differ {diff}"
    if rows != want:
        here, there = set(rows), set(want)
        extra = [r for r in rows if r not in there][:3]
        missing = [r for r in want if r not in here][:3]
        return False, f"rows {len(rows)} vs {len(want)}; spark-only {extra}; sql-only {missing}"
    note = " EMPTY" if not rows else ""
    return True, f"rows={len(rows)}{note} {spent:.1f}s"


def main(keys: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from tidemark.session import local_session

    spark = local_session()
    con = connect()
    known = list(entry.queries())
    picked = [k for k in known if not keys or any(k == q or (q.endswith("*") and k.startswith(q[:-1])) for q in keys)]
    bad = 0
    for key in picked:
        try:
            ok, note = compare(spark, key, con=con)
        except Exception as error:  # noqa: BLE001 - report and continue
            ok, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + key + "  " + note, flush=True)
    print(f"{len(picked) - bad}/{len(picked)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]) and 1)
