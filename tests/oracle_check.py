"""Run every registered query on Spark and its oracle SQL on DuckDB, and
compare schema, row count and values (order-insensitive).

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb  # noqa: I001

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.6g}") if abs(v) >= 1e-9 else 0.0
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _key(row):
    return tuple((0, "") if v is None else (1, str(v)) for v in row)


def compare(spark_pdf, duck_pdf) -> tuple[bool, str]:
    sc = sorted(spark_pdf.columns)
    dc = sorted(duck_pdf.columns)
    if sc != dc:
        return False, f"columns differ: {sc} vs {dc}"
    if len(spark_pdf) != len(duck_pdf):
        return False, f"rows differ: {len(spark_pdf)} vs {len(duck_pdf)}"
    a = sorted((tuple(_norm(x) for x in r) for r in spark_pdf[sc].astype(object).where(
        spark_pdf[sc].notna(), None).itertuples(index=False)), key=_key)
    b = sorted((tuple(_norm(x) for x in r) for r in duck_pdf[sc].astype(object).where(
        duck_pdf[sc].notna(), None).itertuples(index=False)), key=_key)
    bad = 0
    first = None
    for ra, rb in zip(a, b):
        for x, y in zip(ra, rb):
            ok = x == y
            if not ok and isinstance(x, float) and isinstance(y, float):
                ok = abs(x - y) <= 1e-6 * max(1.0, abs(x), abs(y))
            if not ok:
                bad += 1
                first = first or (ra, rb)
                break
    if bad:
        return False, f"{bad} rows differ, first {first}"
    return True, "ok"


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    import __spark_entry__ as E
    from sparkreg.session import local_session

    spark = local_session()
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    todo = names or list(qs)
    n_ok = n_bad = 0
    for name in todo:
        t0 = time.time()
        try:
            sp = qs[name](spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {e!r}"[:400])
            traceback.print_exc(limit=3)
            n_bad += 1
            continue
        t1 = time.time()
        if name not in sqls:
            print(f"ROWS {name}: {len(sp)} rows ({t1 - t0:.1f}s)")
            n_ok += 1
            continue
        try:
            dk = con.execute(sqls[name]).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {e!r}"[:400])
            n_bad += 1
            continue
        ok, msg = compare(sp, dk)
        print(f"{'OK  ' if ok else 'FAIL'} {name}: {msg} ({len(sp)} rows, {t1 - t0:.1f}s)"[:600])
        n_ok += ok
        n_bad += (not ok)
    print(f"== {n_ok} ok, {n_bad} failed")


if __name__ == "__main__":
    main()
