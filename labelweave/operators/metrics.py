"""Multi-label metrics as aggregates over the score table, all models and splits at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUP = ["model", "split"]


def ratio(part: Column, whole: Column) -> Column:
    """Quotient as double, 0 when the divisor is 0 or anything is NULL."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return ratio(F.lit(2.0) * precision * recall, precision + recall)


def confusion(predictions: DataFrame) -> DataFrame:
    """TP, FP, FN, support, rows and absolute error per model, split and label.

    Partial aggregation leaves one row per group and input partition before the shuffle.
    """
    y, p = F.col("y"), F.col("pred")
    return predictions.groupBy(*GROUP, "label", "label_pos").agg(
        F.count_if((y == 1.0) & (p == 1.0)).alias("tp"),
        F.count_if((y == 0.0) & (p == 1.0)).alias("fp"),
        F.count_if((y == 1.0) & (p == 0.0)).alias("fn"),
        F.count_if(y == 1.0).alias("support"),
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(F.abs(y - p)), F.lit(0.0)).alias("abs_error"),
    )


def per_label_metrics(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support from confusion rows."""
    table = counts.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp")))
    table = table.withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return table.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def micro_macro_metrics(per_label: DataFrame) -> DataFrame:
    """Pooled and unweighted averages per model and split."""
    pooled = per_label.groupBy(*GROUP).agg(
        F.sum("tp").alias("_tp"),
        F.sum("fp").alias("_fp"),
        F.sum("fn").alias("_fn"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
    )
    micro_p = ratio(F.col("_tp"), F.col("_tp") + F.col("_fp"))
    micro_r = ratio(F.col("_tp"), F.col("_tp") + F.col("_fn"))
    return pooled.select(
        *GROUP,
        micro_p.alias("micro_precision"),
        micro_r.alias("micro_recall"),
        f1(micro_p, micro_r).alias("micro_f1"),
        "macro_precision",
        "macro_recall",
        "macro_f1",
    )


def hamming_loss(counts: DataFrame) -> DataFrame:
    """Share of wrong (example, label) cells, from confusion rows."""
    return counts.groupBy(*GROUP).agg(
        ratio(F.sum("abs_error"), F.sum("rows")).alias("hamming_loss")
    )


def subset_accuracy(predictions: DataFrame) -> DataFrame:
    """Share of examples with all labels right.

    Counting wrong cells per example is the one aggregate that shuffles a row per example; rows of
    an example written together are combined before it.
    """
    wrong = predictions.groupBy(*GROUP, "example_id").agg(
        F.count_if(~F.col("y").eqNullSafe(F.col("pred"))).alias("_wrong")
    )
    return wrong.groupBy(*GROUP).agg(
        F.avg((F.col("_wrong") == 0).cast("double")).alias("subset_accuracy")
    )


def evaluate(predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary per model and split, metrics per label) for all models and splits.

    The joined tables have one row per model and split.
    """
    labels = per_label_metrics(confusion(predictions))
    summary = (
        subset_accuracy(predictions)
        .join(F.broadcast(hamming_loss(labels)), GROUP)
        .join(F.broadcast(micro_macro_metrics(labels)), GROUP)
    )
    return summary, labels


def metrics_report(summary: DataFrame, labels: DataFrame) -> DataFrame:
    """One nested row per model and split, ready for ``write.json``; lists labels in order."""
    entry = F.struct("label_pos", "label", "precision", "recall", "f1", "support")
    nested = labels.groupBy(*GROUP).agg(
        F.transform(
            F.array_sort(F.collect_list(entry)),
            lambda e: F.struct(
                e["label"].alias("label"),
                e["precision"].alias("precision"),
                e["recall"].alias("recall"),
                e["f1"].alias("f1"),
                e["support"].alias("support"),
            ),
        ).alias("per_label")
    )
    return summary.join(F.broadcast(nested), GROUP).withColumnRenamed("split", "dataset")
