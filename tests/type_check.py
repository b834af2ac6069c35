"""Compare the column types of every query with its oracle's (DuckDB
DESCRIBE, no execution of the oracle).

    python tests/type_check.py [sf_dir]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle_check import duck  # noqa: E402

SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT"}


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    import __spark_entry__ as E
    from sparkreg.session import local_session
    spark = local_session()
    con = duck(sf)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name in sorted(sqls):
        st = {n: SPARK_TO_DUCK.get(t, t.upper()) for n, t in qs[name](spark, sf).dtypes}
        dt = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sqls[name]}").fetchall()}
        diff = {c: (st.get(c), dt.get(c)) for c in set(st) | set(dt) if st.get(c) != dt.get(c)}
        if diff:
            bad += 1
            print(f"TYPE {name}: {diff}")
    print(f"== {len(sqls) - bad} same, {bad} differ")


if __name__ == "__main__":
    main()
