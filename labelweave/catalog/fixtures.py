"""Inputs of the registered queries, derived by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.operators.annotate import (
    collapse_raters,
    filter_unclear,
    primary_label,
    project_taxonomy,
)
from labelweave.operators.split import spread, stratified_split
from labelweave.functions.text import tokenize
from labelweave.scratch import settle
from labelweave.taxonomy import Taxonomy

TAXONOMY = Taxonomy()
# Fixed values: (model, number used by the score rule, has a score).
FIXTURE_MODELS = [
    ("logistic_regression", 0, True),
    ("linear_svm", 3, False),
    ("naive_bayes", 1, True),
    ("random_forest", 2, True),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wanted_partitions(spark: SparkSession) -> int | None:
    """Partitions to deal one-file tables into, where a session (bench, tests) sets it."""
    found = spark.conf.get("spark.labelweave.textPartitions", None)
    return int(found) if found else None


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for work on their texts, spread if the session asks for it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spread(docs, "doc_id", wanted_partitions(spark))


def annotations(spark: SparkSession, sf_dir: str, *, text: bool = True) -> DataFrame:
    """Three raters per document with 28 labels and an unclear flag."""
    docs = table(spark, sf_dir, "documents")
    keys = [F.col("doc_id").alias("id"), *([F.col("text")] if text else [])]
    rated = docs.select(*keys, F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("rater"))
    turn = (F.col("id") + F.col("rater")) % 13
    flag = (
        F.when(turn == 0, F.lit("TRUE"))
        .when(turn == 1, F.lit(" yes "))
        .when(turn == 2, F.lit(None))
        .otherwise(F.lit("False"))
    )
    labels = [
        ((F.col("id") * 131 + F.col("rater") * 17 + i * 29) % (7 + i) == 0).cast("double").alias(c)
        for i, c in enumerate(TAXONOMY.fine)
    ]
    return rated.select("*", flag.alias("example_very_unclear"), *labels)


def collapsed(spark: SparkSession, sf_dir: str, *, text: bool = True) -> DataFrame:
    return collapse_raters(filter_unclear(annotations(spark, sf_dir, text=text)), TAXONOMY.fine)


def coarse(spark: SparkSession, sf_dir: str, *, text: bool = True) -> DataFrame:
    return project_taxonomy(collapsed(spark, sf_dir, text=text), TAXONOMY, ["id", "text"])


def stratified(spark: SparkSession, sf_dir: str, *, text: bool = False) -> DataFrame:
    labelled = coarse(spark, sf_dir, text=text).withColumn(
        "primary_label", primary_label(TAXONOMY.labels)
    )
    # The split reads its input three times, so the shuffled rater table is written once before.
    return stratified_split(settle(labelled, "examples"), "id", "primary_label")


def _benchmark_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(F.explode(tokenize(F.col("text"))).alias("term"))
    return words.distinct()


def _hex_digit(text: Column, position: int) -> Column:
    return F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(text.cast("binary")), position, 1))


def emotion_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, emotion, association) for every term of the benchmark texts."""
    names = F.array(*[F.lit(e) for e in TAXONOMY.emotions])
    rows = _benchmark_terms(spark, sf_dir).select("term", F.explode(names).alias("emotion"))
    digit = F.instr(
        F.lit("0123456789abcdef"),
        F.substring(F.md5(F.concat("term", F.lit(":"), "emotion").cast("binary")), 1, 1),
    )
    return rows.withColumn("association", (digit <= 2).cast("int"))


def emotion_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emotion_rows(spark, sf_dir).filter("association = 1").select("term", "emotion")


def vad_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the benchmark terms have no scores; values are exact sixteenths."""
    term = F.col("term")
    scored = _benchmark_terms(spark, sf_dir).filter(
        ~F.substring(F.md5(term.cast("binary")), 4, 1).isin("0", "1", "2", "3")
    )
    values = [
        ((F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(term.cast("binary")), k, 1)) - 1) / 16.0)
        .cast("double")
        .alias(name)
        for k, name in enumerate(["valence", "arousal", "dominance"], start=1)
    ]
    return scored.select("term", *values)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic scores of four models for every example and coarse label."""
    examples = stratified(spark, sf_dir)
    models = F.array(
        *[
            F.struct(F.lit(name).alias("model"), F.lit(m).alias("m"), F.lit(scored).alias("scored"))
            for name, m, scored in FIXTURE_MODELS
        ]
    )
    labels = F.array(
        *[
            F.struct(F.lit(c).alias("label"), F.lit(i).alias("label_pos"), F.col(c).alias("y"))
            for i, c in enumerate(TAXONOMY.labels)
        ]
    )
    rows = examples.select(F.col("id").alias("example_id"), "split", labels.alias("_l"), F.inline(models))
    rows = rows.select("example_id", "split", "model", "m", "scored", F.inline("_l"))
    value = (
        (F.col("example_id") * 7919 + F.col("m") * 104729 + F.col("label_pos") * 1299709) % 1000
    ).cast("double") / F.lit(1000.0)
    return rows.select(
        "example_id",
        "split",
        "model",
        "label",
        "label_pos",
        "y",
        F.when(F.col("scored"), value).alias("score"),
        (value >= 0.5).cast("double").alias("pred"),
    )


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with quality and toxicity labels, split by their primary label."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("example_id"), "text")
    marks = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("example_id"),
        F.col("quality").cast("double").alias("quality"),
        F.col("toxic").cast("double").alias("toxic"),
    )
    joined = docs.join(marks, "example_id").withColumn(
        "primary_label", primary_label(["quality", "toxic"])
    )
    examples = spread(settle(joined, "examples"), "example_id", wanted_partitions(spark))
    return stratified_split(examples, "example_id", "primary_label").drop("primary_label")
