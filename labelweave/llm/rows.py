"""Small helpers for rows of documents."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.scratch import settle

#: Row numbers up to this count are broadcast (8 bytes each); beyond it the join is shuffled.
BROADCAST_ROWS = 1_000_000


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` stored with a number for each row, so that later reads agree on it."""
    return settle(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")


def bounded(stored: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if the stored table has at most ``limit`` rows."""
    return F.broadcast(stored) if stored.count() <= limit else stored


def without(docs: DataFrame, dropped: DataFrame, name: str) -> DataFrame:
    """Rows of numbered ``docs`` whose number is not in the stored ``dropped`` (column ``_row``)."""
    keys = dropped.select(F.col("_row").alias(name))
    return docs.join(bounded(keys), name, "left_anti").drop(name)


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` stored with the place of each row in the given order, from 1.

    Rows are dealt into ranges, numbered in their range, and the sizes of the ranges before it are added; one
    row for each range reaches the driver. Give an order in which no two rows are equal, else a group of
    equal rows is one range.
    """
    part, place = fresh(df, "_range"), fresh(df, "_place")
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1
    stored = settle(sorted_rows.withColumn(place, within).withColumn(part, F.spark_partition_id()), "ranges")
    sizes = dict(stored.groupBy(part).count().collect())
    before, rows = 0, []
    for at in sorted(sizes):
        rows.append((at, before))
        before += sizes[at]
    offsets = df.sparkSession.createDataFrame(rows, f"{part} int, {name} long")
    return stored.join(F.broadcast(offsets), part).select(*df.columns, (F.col(name) + F.col(place)).alias(name))


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside hand at most ``rows`` rows to Python at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    given = int(before)
    spark.conf.set(name, str(min(rows, given) if given > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release() -> None:
    """Give memory that a finished task has freed back to the system; Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
