"""Compare registered queries with their SQL on whole tables; also usable as a script."""

from __future__ import annotations

import math
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder):
    import duckdb

    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(cell(x) for x in v) + "]"
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(cell(r[i]) for i in order) for r in rows)


def compare(spark, db, folder, name, query, sql):
    """Difference text, or None when rows, columns and values agree."""
    df = query(spark, folder)
    got = rows_of(df.columns, df.collect())
    relation = db.sql(sql)
    columns = list(relation.columns)
    want = rows_of(columns, relation.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}", len(got)
    kinds = {c: str(t) for c, t in zip(columns, relation.types)}
    expected = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}
    for c, t in df.dtypes:
        if expected.get(t, kinds[c]) != kinds[c]:
            return f"type of {c}: {t} != {kinds[c]}", len(got)
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        return f"rows {len(got)} != {len(want)}; only spark {sorted(a)[:3]}; only sql {sorted(b)[:3]}", len(got)
    return None, len(got)


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from pairloom.session import build_session

    folder = "/root/testdata/sf0.01"
    spark = build_session("compare", "local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    db = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if argv and not any(name == a or (a.endswith("*") and name.startswith(a[:-1])) for a in argv):
            continue
        started = time.time()
        try:
            if name in oracles:
                problem, count = compare(spark, db, folder, name, query, oracles[name])
            else:
                problem, count = None, query(spark, folder).count()
        except Exception as error:  # noqa: BLE001
            problem, count = f"{type(error).__name__}: {str(error)[:1500]}", -1
        bad += problem is not None
        mark = "ok " if problem is None else "BAD"
        kind = "" if name in oracles else " (rows only)"
        print(f"{mark} {name} rows={count} {time.time() - started:.1f}s{kind} {problem or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
