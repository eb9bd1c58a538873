"""Run registered queries on Spark and their oracle SQL on DuckDB; compare.

Usage: python tools/oracle_check.py [sf_dir] [name ...]
Compares row count, column names, coarse types and an order-insensitive hash of
the values (doubles rounded to 9 places), like the round's correctness gate.
"""
from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from variantlake.plans import registry  # noqa: E402
from variantlake.session import get_spark  # noqa: E402


def _norm(v):
    if v is None or v is pd.NA:
        return "None"
    if isinstance(v, float):
        if math.isnan(v):
            return "None"
        return repr(round(v, 9) + 0.0)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_norm(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def _kind(dtype) -> str:
    s = str(dtype).lower()
    for k in ("int", "float", "double", "bool", "datetime", "object", "string"):
        if k in s:
            return {"double": "float", "string": "object"}.get(k, k)
    return s


_SPARK_TYPES: dict = {}
_DUCK_OK = {"bigint": {"BIGINT"}, "int": {"INTEGER"}, "double": {"DOUBLE"}, "string": {"VARCHAR"},
            "boolean": {"BOOLEAN"}}


def _rows(pdf: pd.DataFrame):
    cols = sorted(pdf.columns)
    pdf = pdf[cols]
    return cols, sorted("|".join(_norm(v) for v in row) for row in pdf.itertuples(index=False, name=None))


def main():
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    registry.load_all()
    spark = get_spark()
    con = duckdb.connect()
    for t in registry.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    todo = names or list(registry.QUERIES)
    bad = 0
    for name in todo:
        t0 = time.time()
        try:
            sdf = registry.QUERIES[name](spark, sf)
            _SPARK_TYPES.clear()
            _SPARK_TYPES.update({f.name: f.dataType.simpleString() for f in sdf.schema.fields})
            sp = sdf.toPandas()
        except Exception as exc:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(exc).__name__}: {str(exc)[:800]}")
            bad += 1
            continue
        t1 = time.time()
        sql = registry.ORACLES.get(name)
        if sql is None:
            print(f"ROWS {name}: {len(sp)} rows (no oracle) spark={t1 - t0:.1f}s")
            continue
        try:
            dk = con.execute(sql).fetchdf()
        except Exception as exc:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(exc)[:800]}")
            bad += 1
            continue
        duck_types = {c[0]: c[1] for c in con.execute(f"DESCRIBE {sql}").fetchall()}
        c1, r1 = _rows(sp)
        c2, r2 = _rows(dk)
        kinds1 = {c: _kind(sp[c].dtype) for c in sp.columns}
        kinds2 = {c: _kind(dk[c].dtype) for c in dk.columns}
        h1 = hashlib.sha1("\n".join(r1).encode()).hexdigest()
        h2 = hashlib.sha1("\n".join(r2).encode()).hexdigest()
        ok = c1 == c2 and len(r1) == len(r2) and h1 == h2
        status = "PASS" if ok else "FAIL"
        extra = "" if kinds1 == kinds2 else f" types spark={kinds1} duck={kinds2}"
        bad_types = {c: t for c, t in duck_types.items()
                     if t not in _DUCK_OK.get(_SPARK_TYPES.get(c, ""), {t})}
        if bad_types:
            extra += f" sql-types {bad_types} vs spark {[_SPARK_TYPES.get(c) for c in bad_types]}"
        print(f"{status} {name}: rows {len(r1)}/{len(r2)} cols_ok={c1 == c2} spark={t1 - t0:.1f}s{extra}")
        if not ok:
            bad += 1
            if c1 != c2:
                print("   spark cols", c1, "\n   duck  cols", c2)
            else:
                s1, s2 = set(r1), set(r2)
                for x in sorted(s1 - s2)[:4]:
                    print("   spark-only", x[:300])
                for x in sorted(s2 - s1)[:4]:
                    print("   duck-only ", x[:300])
    print(f"done: {len(todo) - bad}/{len(todo)} ok")


if __name__ == "__main__":
    main()
