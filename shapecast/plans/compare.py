"""Run registered queries in Spark and their SQL twins in DuckDB; compare.

Row count, column names and an order-insensitive comparison of the values
(doubles rounded to ``digits`` decimals). Used by the tests and by hand:

    python -m shapecast.plans.compare /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import sys
import time

from ..sources.testdata import TABLES


def duckdb_frame(sql: str, sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    try:
        return con.execute(sql).fetchdf()
    finally:
        con.close()


def _norm(value, digits):
    if value is None:
        return None
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return round(value, digits) + 0.0
    if hasattr(value, "item"):
        return _norm(value.item(), digits)
    if isinstance(value, (list, tuple)):
        return tuple(_norm(v, digits) for v in value)
    return value


def _rows(pdf, digits):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(None if (isinstance(v, float) and math.isnan(v)) else v, digits)
                         for v in rec))
    return cols, sorted(out, key=repr)


def compare(spark, name, builder, sql, sf_dir, digits=6):
    t0 = time.time()
    sdf = builder(spark, sf_dir).toPandas()
    t1 = time.time()
    result = {"name": name, "spark_rows": len(sdf), "spark_sec": round(t1 - t0, 2)}
    if not sql:
        result["status"] = "rows-only"
        return result
    ddf = duckdb_frame(sql, sf_dir)
    result["oracle_rows"] = len(ddf)
    scols, srows = _rows(sdf.astype(object).where(sdf.notna(), None), digits)
    dcols, drows = _rows(ddf.astype(object).where(ddf.notna(), None), digits)
    if scols != dcols:
        result["status"] = f"columns differ: {scols} vs {dcols}"
    elif len(srows) != len(drows):
        result["status"] = "row counts differ"
    elif srows != drows:
        bad = [(a, b) for a, b in zip(srows, drows) if a != b][:3]
        result["status"] = f"values differ, e.g. {bad}"
    else:
        result["status"] = "match"
    return result


def main(argv):
    sys.path.insert(0, ".")
    from ..session import get_spark
    from .registry import load_all
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    spark = get_spark("local[8]", 8)
    reg = load_all()
    bad = 0
    for name, (builder, sql) in reg.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        try:
            r = compare(spark, name, builder, sql, sf_dir)
        except Exception as exc:  # report and go on
            r = {"name": name, "status": f"error: {str(exc)[:400]}"}
        if r["status"] not in ("match", "rows-only"):
            bad += 1
        print(r, flush=True)
    print(f"{bad} problem(s)")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
