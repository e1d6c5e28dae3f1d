"""Run registered queries against DuckDB: ``python -m tests.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
DUCK_TYPE = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "boolean": "BOOLEAN",
}


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    return value


def _bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def difference(spark_df, con, sql: str) -> str | None:
    """None if rows, names and types agree, else what differs."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    oracle_rows = found.fetchall()
    types = dict(
        zip(names, [str(t) for t in con.sql(sql).types], strict=True)
    )
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {spark_df.columns} against {names}"
    for field in spark_df.schema:
        kind = field.dataType.simpleString()
        if DUCK_TYPE.get(kind, kind) != types[field.name]:
            return f"type of {field.name}: {kind} against {types[field.name]}"
    ours = _bag(spark_df.columns, spark_df.collect())
    theirs = _bag(names, oracle_rows)
    if ours != theirs:
        return f"only here {list((ours - theirs).items())[:3]}, only SQL {list((theirs - ours).items())[:3]}"
    return None


def main() -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from tallyfield.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark, con, bad = local_session(8), database(sf_dir), 0
    sqls = entry.oracle_sql()
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = difference(query(spark, sf_dir), con, sqls[name])
            else:
                problem = f"no SQL, {query(spark, sf_dir).count()} rows"
                bad -= 1
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{name:24s} {time.time() - start:6.2f}s {problem or 'ok'}", flush=True)
    print("different:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
