"""Run registered queries against their SQL twins: ``python tests/check_sql.py SF_DIR [name..]``."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(repr(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(plain)


def compare(spark, con, name, sf):
    from __spark_entry__ import oracle_sql, queries

    df = queries()[name](spark, sf)
    got = norm([tuple(r) for r in df.collect()], df.columns)
    sql = oracle_sql().get(name)
    if sql is None:
        return f"rows only: {len(got[1])}"
    res = con.execute(sql)
    want = norm(res.fetchall(), [d[0] for d in res.description])
    if got == want:
        return None if want[1] else "no rows"
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    a, b = set(got[1]), set(want[1])
    return f"rows {len(got[1])} != {len(want[1])}; only ours {sorted(a - b)[:2]}; only theirs {sorted(b - a)[:2]}"


if __name__ == "__main__":
    from topicloom.session import local_session

    sf, names = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    from __spark_entry__ import queries

    chosen = [n for n in queries() if not names or any(n.startswith(x) for x in names)]
    bad = 0
    for n in chosen:
        t = time.time()
        try:
            msg = compare(spark, con, n, sf)
        except Exception as e:
            msg = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += bool(msg) and not msg.startswith("rows only")
        print(f"{'ok ' if not msg else 'BAD'} {n} {time.time() - t:.1f}s {msg or ''}", flush=True)
    print(f"{len(chosen)} run, {bad} bad")
