"""Compare a Spark result with a DuckDB result: names, type families, rows, values."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def canonical(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return bool(value)
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return 0.0 if value == 0 else value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return value


FAMILY = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP",
    "timestamp_ntz": "TIMESTAMP",
}


def compare(df, con, sql: str) -> list[str]:
    """Differences between both sides; an empty list means equal."""
    spark_types = {f.name: FAMILY.get(f.dataType.simpleString(), f.dataType.simpleString())
                   for f in df.schema.fields}
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    duck_types = {d[0]: str(d[1]).split(" ")[0] for d in cursor.description}
    problems = []
    if set(names) != set(spark_types):
        return [f"columns differ: spark-only {set(spark_types) - set(names)}, "
                f"oracle-only {set(names) - set(spark_types)}"]
    for n in names:
        if spark_types[n] != duck_types[n]:
            problems.append(f"type of {n}: {spark_types[n]} vs {duck_types[n]}")
    order = sorted(names)
    at = [names.index(n) for n in order]
    right = [tuple(canonical(row[i]) for i in at) for row in cursor.fetchall()]
    left = [tuple(canonical(row[n]) for n in order) for row in df.collect()]
    if len(left) != len(right):
        problems.append(f"rows: {len(left)} vs {len(right)}")
    key = lambda r: tuple((v is None, str(v)) for v in r)
    extra = sorted(set(left) - set(right), key=key)[:3]
    absent = sorted(set(right) - set(left), key=key)[:3]
    if extra or absent:
        problems.append(f"order {order}\n spark {extra}\n duck  {absent}")
    return problems
