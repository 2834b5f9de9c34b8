"""Joining big tables with lookup tables: broadcast when proven small, salted shuffle beyond."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BROADCAST_ROWS = 1_000_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 32


def is_small(
    df: DataFrame,
    max_rows: int = MAX_BROADCAST_ROWS,
    max_bytes: int = MAX_BROADCAST_BYTES,
) -> bool:
    """Measure ``df`` by one aggregate: at most ``max_rows`` rows and ``max_bytes`` of values.

    Pass a stored table; any other is computed once more.
    """
    width = F.lit(0)
    for item in df.schema.fields:
        if isinstance(item.dataType, T.StringType):
            width = width + F.coalesce(F.octet_length(item.name), F.lit(0)) + 16
        elif isinstance(item.dataType, (T.ArrayType, T.StructType, T.MapType)):
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(item.name))), F.lit(0)) + 16
        else:
            width = width + 8
    probe = df.select(width.cast("long").alias("bytes"))
    rows, size = probe.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def broadcast_if_small(df: DataFrame, **bounds: int) -> DataFrame:
    """``df`` with a broadcast hint if it is measured to be small, else unchanged.

    Unchanged means a sort-merge join whose skewed partitions adaptive execution splits.
    """
    return F.broadcast(df) if is_small(df, **bounds) else df


def left_lookup(
    rows: DataFrame, table: DataFrame, key: str, spread_by: str, *, salts: int = SALTS, **bounds: int
) -> DataFrame:
    """``rows LEFT JOIN table USING (key)`` where a few key values may hold most of ``rows``.

    A table that is too big to broadcast is copied ``salts`` times and the rows of one key value
    are spread over the copies by the hash of ``spread_by``; every row still meets its match
    exactly once.
    """
    if is_small(table, **bounds):
        return rows.join(F.broadcast(table), key, "left")
    salted_rows = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    copies = F.array(*[F.lit(i) for i in range(salts)])
    salted_table = table.withColumn("_salt", F.explode(copies))
    return salted_rows.join(salted_table, [key, "_salt"], "left").drop("_salt")
