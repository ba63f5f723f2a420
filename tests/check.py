"""Run registered queries on Spark and their check SQL on DuckDB.

    python tests/check.py [--sf 0.01] [name ...]
"""
from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = ("region nation customer supplier part orders lineitem events "
          "documents embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM "
                    f"'{sf_dir}/{name}.parquet'")
    return con


def canon(value):
    if value is None:
        return None
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if hasattr(value, "isoformat"):
        return value.isoformat()[:19]
    if isinstance(value, (list, tuple)):
        return tuple(canon(v) for v in value)
    if isinstance(value, bool):
        return value
    if isinstance(value, int):
        return int(value)
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [tuple(canon(r[i]) for i in order) for r in rows], sorted(names)


def compare(spark_rows, duck_rows):
    a, b = Counter(spark_rows), Counter(duck_rows)
    if a == b:
        return "ok"
    only_a, only_b = list((a - b).elements()), list((b - a).elements())
    return (f"DIFF {len(only_a)}/{len(only_b)} of {len(spark_rows)}/"
            f"{len(duck_rows)}\n   spark {sorted(only_a, key=str)[:3]}\n"
            f"   duck  {sorted(only_b, key=str)[:3]}")


def check(spark, con, name, fn, sql, sf_dir):
    start = time.time()
    frame = fn(spark, sf_dir)
    got, names = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    took = time.time() - start
    if sql is None:
        return f"rows-only {len(got)}", took
    rel = con.execute(sql)
    columns = [d[0] for d in rel.description]
    want, want_names = rows_of(columns, rel.fetchall())
    if names != want_names:
        return f"COLUMNS {names} vs {want_names}", took
    return compare(got, want) + f" rows={len(got)}", took


def main(argv):
    from lotwise.session import local_session
    import __spark_entry__ as entry
    sf = "0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(8, **{
        "spark.ui.showConsoleProgress": "false"}), duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if argv and not any(a in name for a in argv):
            continue
        try:
            out, took = check(spark, con, name, fn, oracles.get(name), sf_dir)
        except Exception as exc:                       # noqa: BLE001
            out, took = f"ERROR {type(exc).__name__}: {str(exc)[:700]}", 0.0
        bad += not (out.startswith("ok") or out.startswith("rows-only"))
        print(f"{name:34s} {took:6.2f}s {out}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1:])))
