"""Reading rater annotations from CSV shards and landing them as Parquet."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def header_groups(spark: SparkSession, paths: Sequence[str]) -> list[list[str]]:
    """Files of all paths, grouped by their first line; one job, however many files there are.

    A line with an odd number of quotes goes on in the next one, so such a file is a group of its own.
    """
    lines = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        "value",
    )
    heads = (
        lines.filter("block = 0").groupBy("file").agg(F.min_by("value", "place").alias("head")).orderBy("file").collect()
    )
    groups: dict[tuple[str, ...], list[str]] = {}
    java = spark.sparkContext._jvm
    for row in heads:
        name = java.org.apache.hadoop.fs.Path(java.java.net.URI(row["file"])).toString()
        whole = row["head"].count('"') % 2 == 0
        groups.setdefault((row["head"],) if whole else (row["head"], name), []).append(name)
    return list(groups.values())


def read_annotation_csv(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """All shards as strings, matched by column name; a missing column is an error.

    Quoted texts may contain line breaks, so one file is one task: ship the corpus as many files,
    and land it once with ``land_parquet`` before working on it repeatedly. Files are read by the header they
    have in common; the number of jobs follows the number of different headers.
    """
    if not paths:
        raise ValueError("no annotation shard given")
    reader = lambda: spark.read.options(header=True, multiLine=True, escape='"', quote='"')
    groups = header_groups(spark, paths)
    if not groups:
        return reader().csv(list(paths))
    by_header: dict[tuple[str, ...], list[str]] = {}
    for files in groups:
        by_header.setdefault(tuple(reader().csv(files[0]).columns), []).extend(files)
    # Files with one header are one scan; only different headers need a union.
    scans = [
        reader()
        .schema(T.StructType([T.StructField(c, T.StringType()) for c in header]))
        .csv(files if len(by_header) > 1 else list(paths))
        for header, files in by_header.items()
    ]
    return reduce(lambda left, right: left.unionByName(right), scans)


def write_annotation_csv(df: DataFrame, path: str) -> None:
    """The format ``read_annotation_csv`` reads, with texts kept to the last blank."""
    df.write.mode("overwrite").options(
        header=True,
        escape='"',
        quote='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    ).csv(path)


def land_parquet(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_table(spark: SparkSession, texts: Sequence[str]) -> DataFrame:
    """A handful of ad-hoc texts as a table; bulk texts are read from files instead."""
    rows = [(i, text) for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "example_id long, text string")
