"""Batch scoring of new texts with the saved models of a run."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.functions.narrative import label_result, positive_labels, story, top_labels
from labelweave.operators.features import FeatureModel
from labelweave.operators.scores import ENSEMBLE, vote_share
from labelweave.operators.thresholds import resolve_thresholds, setting
from labelweave.operators.train import (
    COUNTS,
    FAMILIES,
    FEATURES,
    LabelModels,
    input_column,
    label_outputs,
    load_models,
)
from labelweave.sources.artifacts import models_present, read_families, read_thresholds
from labelweave.taxonomy import DESCRIPTORS


@dataclass
class ScoringBundle:
    """Feature transformation, models per family and tuned thresholds of one run."""

    features: FeatureModel
    families: dict[str, LabelModels]
    thresholds: DataFrame | None

    @staticmethod
    def load(spark: SparkSession, out: str, families: list[str] | None = None) -> ScoringBundle:
        """Load the given families, or those of the last run, in the order in which it voted."""
        if families is None:
            saved = models_present(spark, f"{out}/scores")
            wanted = read_families(spark, f"{out}/families") or FAMILIES
            families = [f for f in wanted if f in saved]
        if not families:
            raise FileNotFoundError(f"no trained models under {out}")
        return ScoringBundle(
            FeatureModel.load(spark, f"{out}/models/features"),
            {f: load_models(spark, f"{out}/models/{f}", f) for f in families},
            read_thresholds(spark, f"{out}/thresholds"),
        )


def _threshold_columns(
    bundle: ScoringBundle,
    model: str,
    labels: list[str],
    base: float | None,
    overrides: Mapping[str, float] | None,
) -> dict[str, float]:
    """Effective threshold per label; one row per label reaches the driver."""
    spark = bundle.features.terms.sparkSession
    known = spark.createDataFrame([(c,) for c in labels], "label string")
    if bundle.thresholds is None:
        configured = known.withColumn("threshold", F.lit(None).cast("double"))
    else:
        mine = bundle.thresholds.filter(F.col("model") == model).select("label", "threshold")
        configured = known.join(mine, "label", "left")
    resolved = resolve_thresholds(configured, base=base, overrides=overrides)
    return {row.label: row.threshold for row in resolved.collect()}


def score_table(
    df: DataFrame,
    bundle: ScoringBundle,
    *,
    model: str = ENSEMBLE,
    base_threshold: float | None = None,
    threshold_overrides: Mapping[str, float] | None = None,
    top_n: int = 5,
    descriptors: Mapping[str, tuple[str, str]] = DESCRIPTORS,
) -> DataFrame:
    """``df`` (example_id, text, ...) plus predictions, positive labels, top labels and a story.

    All models of all families run over the row that holds the features, so votes, label lists and
    stories are plain column expressions: scoring shuffles nothing beyond the token measures.
    """
    if model == ENSEMBLE:
        used = list(bundle.families)
        if len(used) < 2:
            raise ValueError("ensemble scoring needs at least two trained model families")
    else:
        if model not in bundle.families:
            raise ValueError(f"no trained models for {model!r}")
        used = [model]
    labels = bundle.families[used[0]].labels
    limits = _threshold_columns(bundle, model, labels, base_threshold, threshold_overrides)

    measured = bundle.features.measure(df)
    inputs = {input_column(f) for f in used}
    rows = measured
    if FEATURES in inputs:
        rows = bundle.features.add_vector(rows, FEATURES)
    if COUNTS in inputs:
        rows = bundle.features.add_vector(rows, COUNTS, non_negative=True)
    outputs: dict[str, dict[str, tuple[Column, Column, Column]]] = {}
    for family in used:
        rows, outputs[family] = label_outputs(rows, bundle.families[family])

    entries = []
    for position, label in enumerate(labels):
        if model == ENSEMBLE:
            score = vote_share([F.coalesce(*outputs[f][label][:2]) for f in used])
            pred, raw = F.when(score >= 0.5, 1.0).otherwise(0.0), None
        else:
            score, pred, raw = outputs[model][label]
        entries.append(
            label_result(
                F.lit(position), F.lit(label), score, pred, setting(limits, F.lit(label)), raw
            )
        )
    results = F.col("predictions")
    scored = rows.select(*df.columns, F.array(*entries).alias("predictions"))
    return scored.select(
        "*",
        positive_labels(results).alias("positive_labels"),
        top_labels(results, top_n).alias("top_labels"),
        story(results, descriptors).alias("story"),
    )

