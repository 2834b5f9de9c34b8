"""Saved tables of a run: optional reads, partitioned writes, fingerprints."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, is_dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.operators.metrics import metrics_report
from labelweave.operators.scores import SCORES_SCHEMA


def read_if_present(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """A Parquet table, or None when nothing was written there yet; other errors are raised."""
    try:
        reader = spark.read.schema(schema) if schema is not None else spark.read
        return reader.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_splits(df: DataFrame, path: str, *, only_given: bool = False) -> None:
    """One folder per split, in place of all there was; ``only_given`` leaves other splits alone."""
    df.write.mode("overwrite").partitionBy("split").option(
        "partitionOverwriteMode", "dynamic" if only_given else "static"
    ).parquet(path)


def folders(spark: SparkSession, path: str, *keys: str) -> set[tuple[str, ...]]:
    """Values of the partition folders ``key=value/...`` below ``path``, listed without reading files.

    Files that a write has finished are there; a folder without any does not count.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    pattern = "/".join([path.rstrip("/"), *(f"{key}=*" for key in keys), "part-*"])
    root = hadoop.Path(pattern)
    found = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(root) or []
    values = set()
    for status in found:
        parts = status.getPath().toString().split("/")[-len(keys) - 1 : -1]
        values.add(tuple(part.split("=", 1)[1] for part in parts))
    return values


def write_scores(scores: DataFrame, path: str) -> None:
    """The score table, a folder per model and split; only those in ``scores`` are replaced."""
    scores.write.mode("overwrite").partitionBy("model", "split").option(
        "partitionOverwriteMode", "dynamic"
    ).parquet(path)


def clear_scores(spark: SparkSession, path: str) -> None:
    """Drop all saved scores, so that none of another parameter set is taken for a finished one."""
    spark.createDataFrame([], SCORES_SCHEMA).write.mode("overwrite").partitionBy(
        "model", "split"
    ).option("partitionOverwriteMode", "static").parquet(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame | None:
    scores = read_if_present(spark, path)
    if scores is None:
        return None
    columns = ["example_id", "split", "model", "label", "label_pos", "y", "score", "pred", "raw"]
    return scores.select(*[c for c in columns if c in scores.columns])


def drop_scores(spark: SparkSession, path: str, model: str) -> None:
    """Drop the saved scores of one model."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/model={model}")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def models_present(spark: SparkSession, path: str) -> set[str]:
    """Model names in the score table saved under ``path``, from its folder names."""
    return {model for model, _ in folders(spark, path, "model", "split")}


def write_families(spark: SparkSession, families: list[str], path: str) -> None:
    """Families of a run, in the order in which the ensemble adds them."""
    rows = list(enumerate(families))
    spark.createDataFrame(rows, "place int, family string").coalesce(1).write.mode("overwrite").json(path)


def read_families(spark: SparkSession, path: str) -> list[str] | None:
    try:
        rows = spark.read.schema("place int, family string").json(path).orderBy("place").collect()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return [row["family"] for row in rows]


def read_holdout(spark: SparkSession, path: str) -> DataFrame | None:
    """The test rows with their texts and labels, if a run has saved them."""
    return read_if_present(spark, path)


def _row_hash(names: list[str]) -> Column:
    # Hashing passes over NULLs, so flags tell which values are missing.
    missing = F.concat(*[F.isnull(c).cast("int").cast("string") for c in names])
    return F.xxhash64(missing, *names).cast("decimal(20,0)")


def content_digest(df: DataFrame) -> list[str]:
    """Row count and sum of row hashes: equal for equal rows in any order. One aggregate."""
    names = sorted(df.columns)
    row = df.agg(F.count(F.lit(1)), F.sum(_row_hash(names))).first()
    return [*names, str(row[0]), str(row[1])]


def keyed_digest(df: DataFrame, key: str) -> list[str]:
    """``content_digest`` and a check of the key in the same pass; raises if a key is missing or repeated."""
    names = sorted(df.columns)
    by_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"), F.sum(_row_hash(names)).alias("_hash"))
    odd = (F.col("_rows") > 1) | F.col(key).isNull()
    row = by_key.agg(F.sum("_rows"), F.sum("_hash"), F.count_if(odd), F.min(F.when(odd, F.col(key)))).first()
    if row[2]:
        raise ValueError(f"{key} {row[3]!r} is missing or repeated")
    return [*names, str(row[0] or 0), str(row[1])]


def write_metrics(summary: DataFrame, labels: DataFrame, path: str) -> None:
    """JSON, one nested record per split in a folder per model."""
    metrics_report(summary, labels).coalesce(1).write.mode("overwrite").partitionBy("model").json(path)


def write_thresholds(thresholds: DataFrame, path: str) -> None:
    thresholds.coalesce(1).write.mode("overwrite").parquet(path)


def read_thresholds(spark: SparkSession, path: str) -> DataFrame | None:
    return read_if_present(spark, path)


def write_samples(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").json(path)


def read_sample_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path).select("text")


def fingerprint(*settings: object) -> str:
    """Digest of the parameters of a run, to tell whether saved tables still fit them."""
    plain = [asdict(s) if is_dataclass(s) else s for s in settings]
    return hashlib.sha256(json.dumps(plain, sort_keys=True, default=str).encode()).hexdigest()


def read_fingerprint(spark: SparkSession, path: str) -> str | None:
    try:
        row = spark.read.text(path).first()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return None if row is None else row[0]


def write_fingerprint(spark: SparkSession, path: str, value: str) -> None:
    spark.createDataFrame([(value,)], "value string").coalesce(1).write.mode("overwrite").text(path)


@dataclass(frozen=True)
class Manifest:
    """Which stages of a run are finished, and from what: the digest of a stage's inputs and settings.

    A stage is opened before its output is touched and closed after all of it is written, so a run that is
    killed leaves open stages open and finished ones finished.
    """

    spark: SparkSession
    path: str

    def finished(self, stage: str) -> str | None:
        """Digest of the finished stage, None if it is open or was never begun."""
        return read_fingerprint(self.spark, f"{self.path}/{stage}") or None

    def holds(self, stage: str, digest: str) -> bool:
        return self.finished(stage) == digest

    def open(self, stage: str) -> None:
        write_fingerprint(self.spark, f"{self.path}/{stage}", "")

    def close(self, stage: str, digest: str) -> None:
        write_fingerprint(self.spark, f"{self.path}/{stage}", digest)


def land_clustered(df: DataFrame, path: str, table: str, key: str, buckets: int) -> DataFrame:
    """Write ``df`` bucketed by ``key``: grouping and joining on ``key`` then need no shuffle.

    Rows are shuffled by the bucket hash first, so each bucket is one file.
    """
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).option(
        "path", path
    ).saveAsTable(table)
    return spark.table(table)


def open_clustered(
    spark: SparkSession, path: str, table: str, key: str, buckets: int
) -> DataFrame | None:
    """Register a table written by ``land_clustered`` in this session; None if it is not there."""
    found = read_if_present(spark, path)
    if found is None:
        return None
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields)
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    spark.sql(
        f"CREATE TABLE {table} ({columns}) USING parquet "
        f"CLUSTERED BY (`{key}`) INTO {int(buckets)} BUCKETS LOCATION '{path}'"
    )
    return spark.table(table)
