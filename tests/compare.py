"""Run registered queries and their SQL checks side by side on the test tables.

    python tests/compare.py [name ...]      (folder from $SF_DIR, default sf0.01)
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (0.0 if value == 0 else value)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _bag(rows, columns) -> Counter:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(_plain(r[k]) for k in order) for r in rows)




def _kind(type_name: str) -> str:
    t = type_name.lower()
    if t.startswith(("bigint", "int", "hugeint", "smallint", "tinyint")):
        return "int"
    if t.startswith(("double", "float", "decimal")):
        return "double"
    if t.startswith(("varchar", "string")):
        return "text"
    return t.split("_")[0]


SEEN: dict[str, int] = {}


def compare(spark, con, name: str, run, oracle: str | None, sf_dir: str) -> str | None:
    """None when equal, else what differs. Without SQL only rows are asked for."""
    df = run(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    SEEN[name] = len(rows)
    if oracle is None:
        return None if rows else "no rows"
    result = con.execute(oracle)
    columns = [d[0] for d in result.description]
    kinds = {d[0]: _kind(str(d[1])) for d in result.description}
    expected = result.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    ours = {f.name: _kind(f.dataType.simpleString()) for f in df.schema.fields}
    if ours != kinds:
        return f"types {ours} != {kinds}"
    got, want = _bag(rows, df.columns), _bag(expected, columns)
    if got != want:
        extra, lacking = got - want, want - got
        return (
            f"rows {len(rows)}/{len(expected)} sorted={sorted(columns)}\n"
            f"    only spark  ({sum(extra.values())}): {list(extra)[:2]}\n"
            f"    only duckdb ({sum(lacking.values())}): {list(lacking)[:2]}"
        )[:1500]
    return None


def main() -> int:
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = sys.argv[1:] or list(queries)
    bad = 0
    for name in names:
        begin = time.time()
        try:
            problem = compare(spark, con, name, queries[name], oracles.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        mark = "ok  " if problem is None else "FAIL"
        kind = "sql " if name in oracles else "rows"
        print(f"{mark} {kind} {time.time() - begin:6.2f}s {SEEN.get(name, 0):8d} {name}", problem or "", flush=True)
        bad += problem is not None
    print(f"{len(names) - bad}/{len(names)} ok, {sum(n in oracles for n in names)} with SQL")
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
