"""Word lexicons as tables: term-emotion pairs and valence/arousal/dominance scores."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = logging.getLogger(__name__)
EMOTION_SCHEMA = "term string, emotion string, association int"
VAD_SCHEMA = "term string, valence double, arousal double, dominance double"
VAD_DIMENSIONS = ["valence", "arousal", "dominance"]


def read_emotion_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated (term, emotion, association) rows without a header; associated pairs only."""
    rows = spark.read.schema(EMOTION_SCHEMA).option("sep", "\t").csv(path)
    return rows.filter(F.col("association") == 1).select("term", "emotion")


def emotion_pairs(rows: DataFrame) -> DataFrame:
    """Distinct (lower-cased term, emotion); spellings that differ by case are united."""
    return rows.select(F.lower("term").alias("term"), "emotion").distinct()


def emotion_sets(rows: DataFrame) -> DataFrame:
    """One row per term with its emotions, sorted."""
    return (
        emotion_pairs(rows)
        .groupBy("term")
        .agg(F.array_sort(F.collect_list("emotion")).alias("emotions"))
    )


def read_vad_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Scores per term from a tab- or comma-separated file with a header in any letter case."""
    reader = spark.read.option("header", True)
    try:
        rows = reader.option("sep", "\t").csv(path)
        if len(rows.columns) < 4:
            rows = reader.option("sep", ",").csv(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no VAD lexicon at {path}") from error
        raise
    rows = rows.toDF(*[name.strip().lower() for name in rows.columns])
    missing = {"term", *VAD_DIMENSIONS} - set(rows.columns)
    if missing:
        raise ValueError(f"VAD lexicon lacks the columns {sorted(missing)}")
    scores = [
        F.coalesce(F.col(name).try_cast("double"), F.lit(0.0)).alias(name)
        for name in VAD_DIMENSIONS
    ]
    return rows.select(F.lower("term").alias("term"), *scores).filter(F.col("term").isNotNull())


def unique_vad_terms(rows: DataFrame) -> DataFrame:
    """One row per term; of several the smallest (valence, arousal, dominance)."""
    smallest = rows.groupBy("term").agg(F.min(F.struct(*VAD_DIMENSIONS)).alias("scores"))
    return smallest.select("term", "scores.*")


def vad_or_empty(spark: SparkSession, path: str | None) -> tuple[DataFrame, bool]:
    """The VAD lexicon and True, or an empty one and False when it cannot be read; the reason is logged."""
    if path is not None:
        try:
            return read_vad_lexicon(spark, path), True
        except (AnalysisException, FileNotFoundError, ValueError) as error:
            LOG.warning("VAD lexicon cannot be read, its features are 0: %s", error)
    return spark.createDataFrame([], VAD_SCHEMA), False
