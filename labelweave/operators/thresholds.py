"""One decision threshold per model and label."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelweave.operators.metrics import f1, ratio


def clean_candidates(candidates: Sequence[float]) -> list[float]:
    """Unique candidates inside [0, 1], four digits, ascending."""
    return sorted({round(float(c), 4) for c in candidates if 0.0 <= c <= 1.0})


def reach_counts(scores: DataFrame, grid: list[float]) -> DataFrame:
    """Positives and negatives per (model, label, number of candidates the score reaches).

    The number is NULL for rows without a score. One pass over the scores, whose rows are not
    multiplied by the number of candidates; the result has len(grid) + 2 rows per model and label.
    """
    reached = F.lit(0)
    for candidate in grid:
        reached = reached + (F.col("score") >= candidate).cast("int")
    return scores.groupBy("model", "label", reached.alias("_reached")).agg(
        F.count_if(F.col("y") == 1.0).alias("_pos"),
        F.count_if(F.col("y") == 0.0).alias("_neg"),
    )


def grid_from_counts(counted: DataFrame, grid: list[float]) -> DataFrame:
    """Add the reach counts up from the highest candidate down."""
    stats = [F.sum("_pos").alias("_all_pos")]
    for i in range(1, len(grid) + 1):
        over = F.col("_reached") >= i
        stats += [
            F.sum(F.when(over, F.col("_pos")).otherwise(0)).alias(f"_tp{i}"),
            F.sum(F.when(over, F.col("_neg")).otherwise(0)).alias(f"_fp{i}"),
        ]
    scored = counted.filter(F.col("_reached").isNotNull())
    summed = scored.groupBy("model", "label").agg(*stats)
    rows = F.array(
        *[
            F.struct(
                F.lit(candidate).alias("threshold"),
                F.col(f"_tp{i}").alias("tp"),
                F.col(f"_fp{i}").alias("fp"),
                (F.col("_all_pos") - F.col(f"_tp{i}")).alias("fn"),
            )
            for i, candidate in enumerate(grid, start=1)
        ]
    )
    table = summed.select("model", "label", F.inline(rows))
    measured = table.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp")))
    measured = measured.withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return measured.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def threshold_grid(scores: DataFrame, candidates: Sequence[float]) -> DataFrame:
    """Confusion counts, precision, recall and F1 per (model, label, candidate).

    Rows without a score take no part.
    """
    grid = clean_candidates(candidates)
    if not grid:
        raise ValueError("no threshold candidate lies in [0, 1]")
    return grid_from_counts(reach_counts(scores, grid), grid)


def best_thresholds(grid: DataFrame) -> DataFrame:
    """Highest F1, then highest recall, then lowest threshold. ``grid`` is small."""
    order = Window.partitionBy("model", "label").orderBy(
        F.desc("f1"), F.desc("recall"), F.asc("threshold")
    )
    return (
        grid.withColumn("_place", F.row_number().over(order))
        .filter(F.col("_place") == 1)
        .drop("_place")
    )


def setting(values: Mapping[str, float], label: Column) -> Column:
    """Value configured for a label, NULL if there is none."""
    if not values:
        return F.lit(None).cast("double")
    pairs = [F.lit(x) for name, value in values.items() for x in (name, float(value))]
    return F.element_at(F.create_map(*pairs), label)


def tune_thresholds(
    validation: DataFrame,
    candidates: Sequence[float],
    configured: Mapping[str, float],
    pairs: DataFrame | None = None,
) -> DataFrame:
    """(model, label, threshold): tuned where the model has scores, else configured, else 0.5.

    ``pairs`` are the (model, label) rows that need a threshold, by default those of ``validation``; pass
    the ones of all scores, so that an empty validation split leaves the configured values in force.
    """
    fallback = F.coalesce(setting(configured, F.col("label")), F.lit(0.5))
    grid = clean_candidates(candidates)
    counted = reach_counts(validation, grid)
    pairs = (counted if pairs is None else pairs).select("model", "label").distinct()
    if not grid:
        return pairs.select("model", "label", fallback.alias("threshold"))
    best = best_thresholds(grid_from_counts(counted, grid)).select(
        "model", "label", F.col("threshold").alias("_tuned")
    )
    # One row per model and label on both sides.
    return pairs.join(F.broadcast(best), ["model", "label"], "left").select(
        "model", "label", F.coalesce("_tuned", fallback).alias("threshold")
    )


def resolve_thresholds(
    configured: DataFrame,
    *,
    base: float | None = None,
    overrides: Mapping[str, float] | None = None,
) -> DataFrame:
    """Effective thresholds: override, else base for all, else configured, else 0.5.

    ``configured`` has one row per known label; overrides of unknown labels are ignored.
    """
    value = F.coalesce(
        setting(overrides or {}, F.col("label")),
        F.lit(base).cast("double"),
        F.col("threshold"),
        F.lit(0.5),
    )
    others = [c for c in configured.columns if c != "threshold"]
    return configured.select(*others, value.alias("threshold"))
