"""Compare registered queries with their SQL on DuckDB.

    python tests/oracle.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(repr(v)) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def compare(spark, con, run, sql, sf_dir) -> tuple[bool, str]:
    df = run(spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(_norm(x) for x in r) for r in df.select(*cols).collect()]
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    rows = cur.fetchall()
    if sorted(names) != cols:
        return False, f"columns {cols} != {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = [tuple(_norm(r[i]) for i in order) for r in rows]
    if len(got) != len(want):
        return False, f"{len(got)} rows != {len(want)}"
    key = lambda r: tuple((x is None, str(type(x) in (int, float)), x if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)) for x in r)
    got.sort(key=key)
    want.sort(key=key)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return False, f"{len(bad)} of {len(got)} rows differ, e.g. {cols}\n   spark {bad[0][0]}\n   duck  {bad[0][1]}"
    return True, f"{len(got)} rows"


def main(argv):
    sf = "/root/testdata/sf0.01"
    if argv and argv[0] == "--sf":
        sf, argv = argv[1], argv[2:]
    import __spark_entry__ as e
    from gaugeworks.session import local_session
    spark, con = local_session("8"), duck(sf)
    sqls, fails = e.oracle_sql(), []
    for name, run in e.queries().items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        t = time.time()
        try:
            if name in sqls:
                ok, msg = compare(spark, con, run, sqls[name], sf)
            else:
                n = len(run(spark, sf).collect())
                ok, msg = n > 0, f"{n} rows (no SQL)"
        except Exception as ex:  # noqa: BLE001
            ok, msg = False, f"{type(ex).__name__}: {str(ex)[:700]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t:.1f}s {msg}", flush=True)
        if not ok:
            fails.append(name)
    print("failed:", fails)


if __name__ == "__main__":
    main(sys.argv[1:])
