"""Run registered queries in Spark and their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def make_session(cores: str = "8", partitions: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("labelweave-tests")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.driver.memory", "8g")
        .config("spark.labelweave.textPartitions", cores)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def _cell(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
}


SECONDS: dict[str, float] = {}


def compare(spark, connection, sf_dir, name, run, sql) -> str | None:
    """None when both engines agree, else what differs."""
    df = run(spark, sf_dir)
    start = time.time()
    got = [tuple(r) for r in df.collect()]
    SECONDS[name] = time.time() - start
    relation = connection.sql(sql)
    want = relation.fetchall()
    want_types = dict(zip(relation.columns, (str(t) for t in relation.types)))
    if sorted(df.columns) != sorted(relation.columns):
        return f"columns {sorted(df.columns)} != {sorted(relation.columns)}"
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        if KINDS.get(kind) != want_types[field.name]:
            return f"type of {field.name}: {kind} != {want_types[field.name]}"
    left, right = _rows(got, df.columns), _rows(want, relation.columns)
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        return f"{len(bad)} rows differ, columns {sorted(df.columns)}: {str(bad[0][0])[:300]} != {str(bad[0][1])[:300]}"
    return None


def main() -> None:
    from __spark_entry__ import oracle_sql, queries

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark = make_session()
    connection = duck(sf_dir)
    sql = oracle_sql()
    failed = 0
    for name, run in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in sql:
                problem = compare(spark, connection, sf_dir, name, run, sql[name])
                verdict = "ok" if problem is None else f"DIFF {problem}"
            else:
                verdict = f"rows {run(spark, sf_dir).count()}"
        except Exception as error:  # report and go on with the next query
            verdict = f"ERROR {str(error)[:600]}"
        failed += verdict.startswith(("DIFF", "ERROR"))
        print(f"{name:32s} {time.time() - start:6.1f}s (collect {SECONDS.get(name, 0):.1f}s) {verdict}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
