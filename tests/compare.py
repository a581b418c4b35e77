"""Runs registered queries against DuckDB and compares the rows.

python -m tests.compare [sf folder] [query ...]
"""

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads TO 8")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(x):
    if x is None:
        return "∅"
    if isinstance(x, float):
        return "∅" if math.isnan(x) else repr(x + 0.0)
    if hasattr(x, "isoformat"):
        text = x.isoformat()
        return text.replace(" ", "T") + ("T00:00:00" if len(text) == 10 else "")
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def duck(con, sql):
    rel = con.execute(sql)
    return rows_of([d[0] for d in rel.description], rel.fetchall())


def spark_rows(df):
    return rows_of(df.columns, [tuple(x) for x in df.collect()])


FAMILY = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
          "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "float": "FLOAT",
          "tinyint": "TINYINT", "smallint": "SMALLINT"}


def types_differ(con, sql, df):
    described = {row[0]: row[1] for row in con.execute("DESCRIBE " + sql).fetchall()}
    return {n: (t, described.get(n)) for n, t in df.dtypes
            if FAMILY.get(t, t) != described.get(n)}


def difference(spark, con, folder, query, sql):
    """None if equal, else a short description."""
    df = query(spark, folder)
    got = spark_rows(df)
    want = duck(con, sql)
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        has, wants = set(got[1]), set(want[1])
        extra, lack = sorted(has - wants)[:2], sorted(wants - has)[:2]
        n = sum(a != b for a, b in zip(got[1], want[1]))
        return f"rows {len(got[1])} / {len(want[1])}, {n} differ; spark {extra} duckdb {lack}"
    kinds = types_differ(con, sql, df)
    return f"types {kinds}" if kinds else None


def main():
    from tests.session import build
    import __spark_entry__ as entry
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = build(), connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = [q for q in queries if not sys.argv[2:] or any(w in q for w in sys.argv[2:])]
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            if name in oracles:
                diff = difference(spark, con, folder, queries[name], oracles[name])
            else:
                rows = queries[name](spark, folder).count()
                diff = None if rows else "no rows"
        except Exception as error:  # report and go on
            diff = f"{type(error).__name__}: {str(error)[:600]}"
        bad += diff is not None
        mark = "ok  " if diff is None else "FAIL"
        kind = "" if name in oracles else " (rows only)"
        print(f"{mark} {time.time() - start:6.1f}s {name}{kind} {diff or ''}"[:1500], flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} agree")


if __name__ == "__main__":
    main()
