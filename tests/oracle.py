"""Run a query next to its SQL statement and compare the rows."""

from __future__ import annotations

import decimal
import glob
import os
import sys
import time

import duckdb

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")

SPARK_TO_DUCK = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
    "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 5) + 0.0)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return repr(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, build, sql, sf_dir):
    """List of differences; empty when the two sides agree."""
    df = build(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return [], len(got)
    con = duck(sf_dir)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = [str(d[1]) for d in result.description]
    want = result.fetchall()
    problems = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"], len(got)
    kinds = dict(zip(names, types))
    for c, t in df.dtypes:
        if SPARK_TO_DUCK.get(t, t) != kinds[c]:
            problems.append(f"type of {c}: {t} against {kinds[c]}")
    a, b = _rows(df.columns, got), _rows(names, want)
    if len(a) != len(b):
        problems.append(f"rows {len(a)} against {len(b)}")
    if a != b:
        only_a = sorted(set(a) - set(b))[:3]
        only_b = sorted(set(b) - set(a))[:3]
        problems.append(f"values\n     ours {only_a}\n     sql  {only_b}")
    return problems, len(got)


def main(names):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from tests.conftest import make_session

    spark = make_session()
    queries, sqls = entry.queries(), entry.oracle_sql()
    chosen = [n for n in queries if not names or any(n.startswith(p) for p in names)]
    bad = 0
    for name in chosen:
        start = time.time()
        try:
            problems, rows = compare(spark, queries[name], sqls.get(name), SF)
        except Exception as error:  # report and go on with the others
            problems, rows = [f"{type(error).__name__}: {str(error)[:1500]}"], -1
        bad += bool(problems)
        mark = "BAD " if problems else ("ok  " if name in sqls else "rows")
        print(f"{mark} {name:28s} rows={rows} {time.time() - start:.2f}s", flush=True)
        for p in problems:
            print("    ", p[:1800], flush=True)
    print(f"{len(chosen)} run, {bad} bad")


if __name__ == "__main__":
    main(sys.argv[1:])
