"""Run registered queries next to their SQL and compare rows: python tests/oracle_check.py [sf_dir] [name ...]"""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int):
        return str(v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    t = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    took = time.time() - t
    if sql is None:
        return "rows-only", len(got), took, ""
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(want_cols):
        return "COLUMNS", len(got), took, f"{sorted(df.columns)} vs {sorted(want_cols)}"
    a, b = rows_of(df.columns, got), rows_of(want_cols, want)
    if a == b:
        kinds = sorted((c, t) for c, t in df.dtypes if t.startswith(("array", "map", "struct")))
        return ("ok" if got else "EMPTY"), len(got), took, str(kinds) if kinds else ""
    sa, sb = set(a), set(b)
    return "DIFF", len(got), took, f"{len(a)} vs {len(b)} rows; only spark {[x for x in a if x not in sb][:2]}; only sql {[x for x in b if x not in sa][:2]}"


def main():
    from wardstone.session import local_session
    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con = local_session(), connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            status, n, took, note = compare(spark, con, name, fn, oracle.get(name), sf_dir)
        except Exception as exc:
            status, n, took, note = "ERROR", 0, 0.0, str(exc)[:1500]
        bad += status not in ("ok", "rows-only")
        print(f"{status:9} {name:34} rows={n:<7} {took:6.2f}s {note}", flush=True)
    print("not ok:", bad)


if __name__ == "__main__":
    main()
