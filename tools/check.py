"""Run named queries against their check SQL in DuckDB.

    python tools/check.py [--sf 0.01] [--explain] [name-or-module ...]
"""

import argparse
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from trueframe.plans import QUERIES, registry  # noqa: E402
from trueframe.session import local_session  # noqa: E402


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for name in frame.columns:
        kinds = {type(v).__name__ for v in frame[name] if v is not None and v == v}
        if kinds <= {"int", "float", "Decimal", "int64", "int32", "float64", "bool"} and "bool" not in kinds:
            frame[name] = [None if v is None or v != v else round(float(v), 7) + 0.0 for v in frame[name]]
        else:
            frame[name] = [None if v is None or (isinstance(v, float) and v != v) else str(v) for v in frame[name]]
    keys = [frame[c].map(lambda v: (v is None, str(v))) for c in frame.columns]
    order = sorted(range(len(frame)), key=lambda i: tuple(k.iloc[i] for k in keys))
    return frame.iloc[order].reset_index(drop=True)


def family(kind: str) -> str:
    kind = kind.lower()
    for name, words in {"int": ("bigint", "long"), "int32": ("integer", "int"), "double": ("double",),
                        "text": ("string", "varchar"), "bool": ("bool",), "decimal": ("decimal",),
                        "time": ("timestamp",)}.items():
        if any(kind.startswith(w) for w in words):
            return name
    return kind


def main():
    args = argparse.ArgumentParser()
    args.add_argument("names", nargs="*")
    args.add_argument("--sf", default="0.01")
    args.add_argument("--explain", action="store_true")
    args.add_argument("--show", action="store_true")
    opts = args.parse_args()
    path = f"/root/testdata/sf{opts.sf}"
    spark = local_session(8)
    db = duckdb.connect()
    for t in registry.TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    oracles = registry.oracle_sql()
    bad = 0
    for name, fn in QUERIES.items():
        if opts.names and name not in opts.names and not any(
                n == getattr(fn, "_home", None) for n in opts.names):
            continue
        started = time.time()
        try:
            df = fn(spark, path)
            if opts.explain:
                df.explain("formatted")
            got = df.toPandas()
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: spark {type(error).__name__} {str(error)[:1500]}", flush=True)
            continue
        spent = time.time() - started
        if opts.show:
            print(got.head(12).to_string())
        if name not in oracles:
            print(f"rows {name}: {len(got)} {spent:.1f}s", flush=True)
            continue
        try:
            begun = time.time()
            cursor = db.execute(oracles[name])
            want_types = {c[0]: str(c[1]) for c in cursor.description}
            want = pd.DataFrame(cursor.fetchall(), columns=list(want_types))
            plain = time.time() - begun
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: check SQL {str(error)[:1200]}", flush=True)
            continue
        problems = []
        if sorted(got.columns) != sorted(want.columns):
            problems.append(f"columns {sorted(got.columns)} vs {sorted(want.columns)}")
        else:
            for field in df.schema:
                a, b = family(field.dataType.simpleString()), family(want_types[field.name])
                if a != b:
                    problems.append(f"type {field.name}: {a} vs {b}")
            got2 = pd.DataFrame({c: [v for v in got[c].astype(object)] for c in got.columns})
            a, b = normal(got2), normal(want)
            if len(a) != len(b):
                problems.append(f"rows {len(a)} vs {len(b)}")
            elif not a.equals(b):
                diff = [(c, i) for c in a.columns for i in range(len(a)) if a[c][i] != b[c][i] and not (a[c][i] is None and b[c][i] is None)]
                diff = [(c, i) for c, i in diff if not (isinstance(a[c][i], float) and isinstance(b[c][i], float) and a[c][i] != a[c][i] and b[c][i] != b[c][i])]
                if diff:
                    c, i = diff[0]
                    problems.append(f"{len(diff)} cells, first {c}[{i}] {a[c][i]!r} vs {b[c][i]!r}; row {a.iloc[i].to_dict()} vs {b.iloc[i].to_dict()}")
        if problems:
            bad += 1
            print(f"DIFF {name}: {'; '.join(problems)[:1500]}", flush=True)
        else:
            flag = " EMPTY" if not len(got) else ""
            print(f"ok   {name}: {len(got)} rows {spent:.1f}s (check {plain:.1f}s){flag}", flush=True)
    print("bad", bad)


if __name__ == "__main__":
    main()
