"""Run queries beside their SQL twins: python -m checks.compare SF_DIR [name ...]"""

import math
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import DataFrame

from checks.oracle import oracles
from checks.queries import registry

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]
TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def _rows(names: list[str], rows: list[tuple]) -> tuple[list[str], Counter]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], Counter(tuple(_value(r[i]) for i in order) for r in rows)


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> tuple[int, list[str]]:
    """Number of rows and what differs: columns, types, rows."""
    names, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    want_types = {d[0]: str(d[1]) for d in cursor.description}
    want_names, want = _rows(list(want_types), cursor.fetchall())
    found = []
    if names != want_names:
        found.append(f"columns {names} instead of {want_names}")
    for name, kind in df.dtypes:
        if TYPES.get(kind) != want_types.get(name):
            found.append(f"{name} is {kind}, in SQL {want_types.get(name)}")
    if got != want:
        more, less = list((got - want).items())[:2], list((want - got).items())[:2]
        found.append(f"{sum(got.values())} rows instead of {sum(want.values())}; only here {more}; only there {less}")
    return sum(got.values()), found


def main() -> None:
    from spanloom.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(sf_dir), oracles(), []
    for name, fn in registry().items():
        if names and name not in names:
            continue
        began = time.time()
        try:
            df = fn(spark, sf_dir)
            n, found = differences(df, con, sql[name]) if name in sql else (df.count(), ["no SQL"])
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            n, found = 0, [str(error)[:1500]]
        print(f"{name}: {n} rows, {time.time() - began:.1f} s", *found, sep="\n    ", flush=True)
        if found and found != ["no SQL"]:
            bad.append(name)
    print("differ:", bad)


if __name__ == "__main__":
    main()
