"""Per-example summaries of scored labels, on an array column of label results.

Each element is a struct (label_pos, label, score, pred, threshold, predicted, raw), in label order.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_result(
    position: Column,
    label: Column,
    score: Column,
    pred: Column,
    threshold: Column,
    raw: Column | None = None,
) -> Column:
    """One array element; positive by score where there is one, else by the model's prediction."""
    predicted = F.when(score.isNotNull(), score >= threshold).otherwise(pred >= 0.5)
    return F.struct(
        position.cast("int").alias("label_pos"),
        label.alias("label"),
        score.cast("double").alias("score"),
        pred.cast("double").alias("pred"),
        threshold.cast("double").alias("threshold"),
        F.coalesce(predicted, F.lit(False)).alias("predicted"),
        (F.lit(None) if raw is None else raw).cast("double").alias("raw"),
    )


def gather_labels(scored: DataFrame, *keys: str) -> DataFrame:
    """Label rows to one array per ``keys``; a group has one row per label, no more."""
    element = label_result(
        F.col("label_pos"), F.col("label"), F.col("score"), F.col("pred"), F.col("threshold")
    )
    return scored.groupBy(*keys).agg(F.array_sort(F.collect_list(element)).alias("predictions"))


def by_score(results: Column) -> Column:
    """Scored elements, best first, ties in label order."""
    scored = F.filter(results, lambda r: r["score"].isNotNull())
    ranked = F.transform(
        scored, lambda r: F.struct((-r["score"]).alias("rank"), r["label_pos"].alias("pos"), r.alias("item"))
    )
    return F.transform(F.array_sort(ranked), lambda r: r["item"])


def names(results: Column) -> Column:
    return F.transform(results, lambda r: r["label"])


def positive_labels(results: Column) -> Column:
    return names(F.filter(results, lambda r: r["predicted"]))


def top_labels(results: Column, top_n: int = 5) -> Column:
    """Best ``top_n`` labels by score; without any score the predicted ones in label order."""
    scored = by_score(results)
    return F.when(F.size(scored) > 0, F.slice(names(scored), 1, top_n)).otherwise(
        F.slice(positive_labels(results), 1, top_n)
    )


def _capitalized(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(text.substr(F.lit(2), F.length(text))))


def _percent(score: Column) -> Column:
    return F.concat(F.rint(score * 100).cast("long").cast("string"), F.lit("%"))


def _describe(descriptors: Mapping[str, str], label: Column) -> Column:
    if not descriptors:
        return label
    pairs = [F.lit(x) for item in descriptors.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), label), label)


def story(results: Column, descriptors: Mapping[str, tuple[str, str]]) -> Column:
    """A sentence about the one or two strongest labels at or above their thresholds."""
    tones = {label: tone for label, (tone, _) in descriptors.items()}
    headlines = {label: headline for label, (_, headline) in descriptors.items()}
    confident = F.filter(by_score(results), lambda r: r["score"] >= r["threshold"])
    leader = F.get(confident, F.lit(0))
    support = F.get(confident, F.lit(1))
    muted = F.get(F.filter(results, lambda r: r["predicted"]), F.lit(0))

    def headline(item: Column) -> Column:
        return _capitalized(_describe(headlines, item["label"]))

    two = F.concat(
        headline(leader),
        F.lit(" lead the narrative ("),
        _percent(leader["score"]),
        F.lit("), with a "),
        _describe(tones, support["label"]),
        F.lit(" undertone from "),
        support["label"],
        F.lit(" ("),
        _percent(support["score"]),
        F.lit(")."),
    )
    one = F.concat(
        headline(leader),
        F.lit(" set a "),
        _describe(tones, leader["label"]),
        F.lit(" tone at "),
        _percent(leader["score"]),
        F.lit("."),
    )
    faint = F.concat(headline(muted), F.lit(" emerge despite muted probability scores."))
    return (
        F.when(support.isNotNull(), two)
        .when(leader.isNotNull(), one)
        .when(muted.isNotNull(), faint)
        .otherwise(F.lit("Emotional signals stay below all configured thresholds."))
    )
