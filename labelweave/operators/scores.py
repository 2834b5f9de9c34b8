"""The long score table: one row per example, model and label."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCORES_SCHEMA = (
    "example_id long, split string, model string, label string, label_pos int, "
    "y double, score double, pred double, raw double"
)
ENSEMBLE = "majority_vote"


def label_table(labels: list[str]) -> Column:
    """Labels with their position, as an array literal to explode or look up."""
    return F.array(
        *[F.struct(F.lit(i).alias("label_pos"), F.lit(c).alias("label")) for i, c in enumerate(labels)]
    )


def positive_score(df: DataFrame, column: str, *, last: bool = False) -> Column:
    """Score of the positive class: entry 1 of a vector (its last for voting) or the scalar.

    A vector with a single entry yields NULL for entry 1 instead of failing.
    """
    if column not in df.columns:
        raise ValueError(f"no column {column!r} to take a score from")
    if isinstance(df.schema[column].dataType, VectorUDT):
        values = vector_to_array(F.col(column))
        return F.element_at(values, -1) if last else F.get(values, F.lit(1))
    return F.col(column).cast("double")


def _models(scores: DataFrame, models: list[str] | None) -> list[str]:
    """Names to combine, in the order their scores are added."""
    if models is None:
        models = sorted(r.model for r in scores.select("model").distinct().collect())
    if len(models) < 2:
        raise ValueError("an ensemble needs the scores of at least two models")
    return models


def _with_key(scores: DataFrame) -> tuple[DataFrame, str]:
    """The scores and the column that tells examples apart: their key, or else a digest of their text."""
    if "example_id" in scores.columns:
        return scores, "example_id"
    if "text" not in scores.columns:
        raise ValueError("scores lack an example_id and a text to join by")
    digest = F.md5(F.col("text").cast("binary")).alias("text_digest")
    rest = [c for c in scores.columns if c != "text"]
    keyed = scores.filter(F.col("text").isNotNull()).select(digest, *rest)
    twice = keyed.groupBy("text_digest", "model", "label").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"a text occurs more than once ({twice[0]['text_digest']}); give the scores an example_id")
    return keyed, "text_digest"


def prediction_join(scores: DataFrame, models: list[str] | None = None) -> DataFrame:
    """One row per (example, label) present in all models, with a score and pred column for each.

    A grouped pivot: one shuffle for any number of models, in place of a join per model. A model that has
    several rows for an example and label counts once; its largest score and prediction are taken. Scores
    without ``example_id`` are joined by the 128-bit digest of their ``text``, as ``text_digest``; a missing text
    joins nothing, and a repeated one raises an error, as its rows cannot be told apart.
    """
    if "label" not in scores.columns:
        raise ValueError("scores lack the column label")
    scores, key = _with_key(scores)
    names = _models(scores, models)
    columns = []
    for name in names:
        mine = F.col("model") == name
        columns += [
            F.max(F.when(mine, F.col("score"))).alias(f"score_{name}"),
            F.max(F.when(mine, F.col("pred"))).alias(f"pred_{name}"),
            F.max(mine.cast("int")).alias(f"_has_{name}"),
        ]
    joined = scores.groupBy(key, "split", "label", "label_pos").agg(
        F.max("y").alias("y"), *columns
    )
    flags = [f"_has_{name}" for name in names]
    every = F.lit(True)
    for flag in flags:
        every = every & (F.col(flag) == 1)
    return joined.filter(every).drop(*flags)


def vote_share(votes: list[Column]) -> Column:
    """Average of the votes, added in the given order so that the result is bit-stable."""
    total = votes[0]
    for vote in votes[1:]:
        total = total + vote
    return total / F.lit(float(len(votes)))


def majority_vote(scores: DataFrame, models: list[str] | None = None) -> DataFrame:
    """Score rows of the ensemble: a model's score, or its 0/1 prediction if it has no score."""
    names = _models(scores, models)
    joined = prediction_join(scores, names)
    # The ensemble has no raw value; the column is there where the models have one.
    raw = [F.lit(None).cast("double").alias("raw")] if "raw" in scores.columns else []
    share = vote_share([F.coalesce(f"score_{m}", f"pred_{m}") for m in names])
    return joined.withColumn("score", share).select(
        joined.columns[0],  # the key
        "split",
        F.lit(ENSEMBLE).alias("model"),
        "label",
        "label_pos",
        "y",
        "score",
        F.when(F.col("score") >= 0.5, 1.0).otherwise(0.0).alias("pred"),
        *raw,
    )


def canonical_predictions(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``pred`` by threshold where there is a score, else the model's own 0/1 prediction.

    ``thresholds`` is (model, label, threshold), a row per pair; pairs without one use 0.5.
    """
    joined = scores.join(F.broadcast(thresholds), ["model", "label"], "left")
    threshold = F.coalesce("threshold", F.lit(0.5))
    decided = F.when(
        F.col("score").isNotNull(), (F.col("score") >= threshold).cast("double")
    ).otherwise(F.col("pred"))
    return joined.select(
        "example_id", "split", "model", "label", "label_pos", "y", "score",
        decided.alias("pred"), threshold.alias("threshold"),
    )


def prediction_columns(
    predictions: DataFrame, labels: list[str], texts: DataFrame | None = None
) -> DataFrame:
    """Wide view: one row per (example, split, model) with y and ``pred_<label>`` columns.

    ``texts`` (example_id, text) adds the text of each example.
    """
    columns = []
    for label in labels:
        mine = F.col("label") == label
        columns += [
            F.max(F.when(mine, F.col("y"))).alias(label),
            F.max(F.when(mine, F.col("pred"))).alias(f"pred_{label}"),
        ]
    wide = predictions.groupBy("example_id", "split", "model").agg(*columns)
    if texts is None:
        return wide
    return wide.join(texts.select("example_id", "text"), "example_id", "left")
