"""Compare a query's rows with what its SQL gives in DuckDB."""

import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


def database(sf_dir):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return db


def differences(df, db, sql):
    names = sorted(df.columns)
    got = sorted([[plain(r[c]) for c in names] for r in df.collect()], key=str)
    cur = db.execute(sql)
    cols = [d[0] for d in cur.description]
    rows = cur.fetchall()
    if sorted(cols) != names:
        return [("columns", names, sorted(cols))]
    want = sorted([[plain(r[cols.index(c)]) for c in names] for r in rows], key=str)
    return [] if got == want else [x for x in zip(got, want) if x[0] != x[1]][:3] or [("rows", len(got), len(want))]
