"""Run registered queries against their SQL twins: python tests/compare.py [sf_dir] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return value


def spark_rows(df):
    names = sorted(df.columns)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    rows = sorted(repr(tuple(_cell(r[n]) for n in names)) for r in df.collect())
    return names, kinds, rows


def duck_rows(con, sql):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]).lower() for d in result.description}
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = sorted(repr(tuple(_cell(r[i]) for i in order)) for r in result.fetchall())
    return [names[i] for i in order], kinds, rows


SAME_TYPE = {"bigint": "bigint", "int": "integer", "string": "varchar", "double": "double", "boolean": "boolean"}


def check(spark, con, name, query, sql, sf_dir) -> str | None:
    names, kinds, rows = spark_rows(query(spark, sf_dir))
    duck_names, duck_kinds, expected = duck_rows(con, sql)
    if names != duck_names:
        return f"columns {names} != {duck_names}"
    for column in names:
        if SAME_TYPE.get(kinds[column], kinds[column]) != duck_kinds[column]:
            return f"type of {column}: {kinds[column]} != {duck_kinds[column]}"
    if rows != expected:
        only = [r for r in rows if r not in set(expected)][:3]
        missing = [r for r in expected if r not in set(rows)][:3]
        return f"{len(rows)} rows, expected {len(expected)}; only here {only}; missing {missing}"
    if not rows:
        return "no rows"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from quotemill.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = local_session(), connect(sf_dir)
    wanted = sys.argv[2:] or list(entry.queries())
    bad = 0
    for name in wanted:
        started = time.time()
        try:
            problem = check(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], sf_dir)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"\n@@ {'ok  ' if problem is None else 'FAIL'} {name} {time.time() - started:.1f}s {problem or ''}", flush=True)
    print(f"\n@@ {len(wanted) - bad} of {len(wanted)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main())
