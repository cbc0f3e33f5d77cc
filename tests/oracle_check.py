"""Run registered queries in Spark and their SQL in DuckDB; compare as bags.

Usage: python tests/oracle_check.py [sf_dir] [key ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

DRIVER_TABLES = ("region nation customer supplier part orders lineitem events documents "
                 "embeddings pages benchmark labels conversations").split()


def duck_connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


STRICT = os.environ.get("ORACLE_STRICT") == "1"


def _canon(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v if STRICT else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat(sep=" ") if isinstance(v, dt.datetime) else v.isoformat()
    if hasattr(v, "asDict"):
        return str(sorted((k, _canon(x)) for k, x in v.asDict().items()))
    if isinstance(v, (list, tuple)):
        return str([_canon(x) for x in v])
    if isinstance(v, dict):
        return str(sorted((k, _canon(x)) for k, x in v.items()))
    return v


def _key(row):
    return tuple((0, "") if x is None else (1, str(type(x))) + ((x,) if not isinstance(x, str) else (x,))
                 for x in row)


def canon_rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_canon(r[i]) for i in order) for r in rows]
    out.sort(key=lambda r: tuple(("~" if x is None else repr(x)) for x in r))
    return [cols[i] for i in order], out


def duck_type(t) -> str:
    """The DuckDB type name a Spark column type should come out as."""
    from pyspark.sql import types as T
    if isinstance(t, T.LongType):
        return "BIGINT"
    if isinstance(t, T.IntegerType):
        return "INTEGER"
    if isinstance(t, T.DoubleType):
        return "DOUBLE"
    if isinstance(t, T.DecimalType):
        return f"DECIMAL({t.precision},{t.scale})"
    if isinstance(t, T.StringType):
        return "VARCHAR"
    if isinstance(t, T.BooleanType):
        return "BOOLEAN"
    if isinstance(t, T.TimestampNTZType):
        return "TIMESTAMP"
    return t.simpleString()


def compare(spark, key, sf_dir, con=None, verbose=True):
    from pricetide.plans.oracle import ORACLE
    from pricetide.plans.registry import QUERIES
    con = con or duck_connect(sf_dir)
    t0 = time.time()
    sdf = QUERIES[key](spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    scols = sdf.columns
    if key not in ORACLE:
        return {"key": key, "ok": None, "rows": len(srows), "spark_s": t1 - t0}
    rel = con.sql(ORACLE[key])
    dtypes = dict(zip(rel.columns, [str(t) for t in rel.types]))
    res = con.execute(ORACLE[key])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    type_diff = [(f.name, duck_type(f.dataType), dtypes.get(f.name)) for f in sdf.schema.fields
                 if duck_type(f.dataType) != dtypes.get(f.name)]
    sc, sr = canon_rows(scols, srows)
    dc, dr = canon_rows(dcols, drows)
    ok = sc == dc and sr == dr
    info = {"key": key, "ok": ok, "rows": len(srows), "oracle_rows": len(drows), "spark_s": round(t1 - t0, 2),
            "types_ok": not type_diff}
    if type_diff:
        info["type_diff"] = type_diff
    if not ok and verbose:
        if sc != dc:
            info["cols"] = (sc, dc)
        else:
            a, b = set(sr), set(dr)
            info["only_spark"] = sorted(a - b, key=repr)[:3]
            info["only_oracle"] = sorted(b - a, key=repr)[:3]
    return info


def main(argv):
    from pricetide.plans.registry import QUERIES
    from pricetide.session import build_session
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:] or list(QUERIES)
    spark = build_session(shuffle_partitions=int(os.environ.get("ORACLE_PARTITIONS", "8")))
    con = duck_connect(sf_dir)
    bad = 0
    for k in keys:
        try:
            info = compare(spark, k, sf_dir, con)
        except Exception as e:  # report and continue
            info = {"key": k, "ok": False, "error": repr(e)[:800]}
        bad += info.get("ok") is False
        print(info, flush=True)
    print("FAILED" if bad else "ALL OK", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
