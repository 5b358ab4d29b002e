"""Comparison of results as sorted lists of plain values."""

import datetime
import decimal
import glob
import math
import os


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, int):
        return float(v) if abs(v) < 2**53 else v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v.replace(tzinfo=None)) if isinstance(v, datetime.datetime) else v


def rows(df):
    names = sorted(df.columns)
    return sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)


def duck(folder):
    import duckdb

    db = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return db


def sql_rows(db, sql):
    cursor = db.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(names)
    return order, sorted((tuple(plain(r[names.index(c)]) for c in order) for r in cursor.fetchall()), key=repr)
