"""Compare registered queries with their SQL checks: row count, columns, order-free values."""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return f"{v:.6f}".rstrip("0").rstrip(".")
    if isinstance(v, bool):
        return str(v)
    return str(v)


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(cell(r[i]) for i in order) for r in rows]
    return sorted(cells, key=lambda r: [(c is None, c or "") for c in r]), [columns[i] for i in order]


def compare(df, con, sql):
    """None when equal, else a short description of the difference."""
    mine, my_cols = sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    theirs, their_cols = sorted_rows([d[0] for d in cur.description], cur.fetchall())
    if my_cols != their_cols:
        return f"columns {my_cols} and {their_cols}"
    if mine != theirs:
        a = [r for r in mine if r not in set(map(tuple, theirs))][:3]
        b = [r for r in theirs if r not in set(map(tuple, mine))][:3]
        return f"rows {len(mine)} and {len(theirs)}; only in job {a}; only in SQL {b}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from webloom.plans import all_queries
    from webloom.session import build_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = oracle(sf_dir), 0
    for name, q in all_queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            df = q.run(spark, sf_dir)
            if q.sql:
                found = compare(df, con, q.sql) or f"ok ({df.count() if wanted else ''})"
            else:
                rows = df.collect()
                found = f"rows {len(rows)} {str(rows[:2])[:200] if wanted else ''}"
        except Exception as e:  # noqa: BLE001
            found = "ERROR " + str(e)[:1500]
        bad += not found.startswith(("ok", "rows"[:4])) or "only in" in found
        print(f"{name:32s} {time.time() - start:6.2f}s {found[:1500]}", flush=True)
    print("bad:", bad)
