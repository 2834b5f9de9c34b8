"""One binary MLlib model per label, for four model families."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.classification import (
    LinearSVC,
    LinearSVCModel,
    LogisticRegression,
    LogisticRegressionModel,
    NaiveBayes,
    NaiveBayesModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.operators import forest
from labelweave.operators.linear import linear_stage
from labelweave.operators.scores import positive_score
from labelweave.scratch import settle

FEATURES = "features"
COUNTS = "features_non_negative"
FAMILIES = ["logistic_regression", "linear_svm", "naive_bayes", "random_forest"]
#: Families whose models are weights of the features.
LINEAR = FAMILIES[:3]
#: Rows that a forest's bags are drawn from at a time. A bag follows a row's place in its block, so this number is
#: part of a forest's meaning, like its seed.
BAG_ROWS = 10_000
MODEL_CLASSES = {
    "logistic_regression": LogisticRegressionModel,
    "linear_svm": LinearSVCModel,
    "naive_bayes": NaiveBayesModel,
    "random_forest": RandomForestClassificationModel,
}


@dataclass(frozen=True)
class TrainParams:
    lr_reg: float = 0.1
    lr_elastic_net: float = 0.0
    lr_max_iter: int = 50
    svm_reg: float = 0.1
    svm_max_iter: int = 50
    nb_smoothing: float = 1.0
    rf_trees: int = 100
    rf_depth: int = 12
    rf_subsample: float = 0.8
    seed: int = 42
    parallel_fits: int = 4
    #: Rows of a fit's partition, on average.
    rows_per_partition: int = 10_000


# Settings of TrainParams that shape the models of a family.
_SETTINGS = {
    "logistic_regression": ("lr_reg", "lr_elastic_net", "lr_max_iter", "rows_per_partition"),
    "linear_svm": ("svm_reg", "svm_max_iter", "rows_per_partition"),
    "naive_bayes": ("nb_smoothing", "rows_per_partition"),
    "random_forest": ("rf_trees", "rf_depth", "rf_subsample", "seed"),
}


def family_settings(family: str, params: TrainParams) -> dict[str, float]:
    """The settings that, if changed, give the family other models."""
    check_family(family)
    return {name: getattr(params, name) for name in _SETTINGS[family]}


@dataclass
class LabelModels:
    """Fitted models of one family; a label seen with one class only has a constant score."""

    family: str
    labels: list[str]
    models: dict[str, object]
    constants: dict[str, float] = field(default_factory=dict)
    summaries: dict[str, dict[str, float]] = field(default_factory=dict)


def input_column(family: str) -> str:
    """Naive Bayes needs non-negative features; the others take them as they are."""
    return COUNTS if family == "naive_bayes" else FEATURES


def check_family(family: str) -> None:
    if family not in MODEL_CLASSES:
        raise ValueError(f"unsupported model family {family!r}; choose from {FAMILIES}")


def _estimator(family: str, label: str, params: TrainParams):
    common = {"featuresCol": input_column(family), "labelCol": label, "predictionCol": f"pred_{label}"}
    if family == "logistic_regression":
        return LogisticRegression(
            regParam=params.lr_reg, elasticNetParam=params.lr_elastic_net,
            maxIter=params.lr_max_iter, probabilityCol=f"prob_{label}",
            rawPredictionCol=f"raw_{label}", **common,
        )
    if family == "linear_svm":
        return LinearSVC(
            regParam=params.svm_reg, maxIter=params.svm_max_iter, rawPredictionCol=f"raw_{label}", **common
        )
    if family == "naive_bayes":
        return NaiveBayes(
            smoothing=params.nb_smoothing, modelType="multinomial",
            probabilityCol=f"prob_{label}", rawPredictionCol=f"raw_{label}", **common,
        )
    return RandomForestClassifier(
        numTrees=params.rf_trees, maxDepth=params.rf_depth, subsamplingRate=params.rf_subsample,
        featureSubsetStrategy="auto", seed=params.seed, probabilityCol=f"prob_{label}",
        rawPredictionCol=f"raw_{label}", **common,
    )


def _summary(family: str, model, params: TrainParams) -> dict[str, float]:
    if family == "logistic_regression":
        found = {
            "regParam": params.lr_reg, "elasticNetParam": params.lr_elastic_net,
            "maxIter": float(params.lr_max_iter),
        }
        if model.hasSummary and model.summary.objectiveHistory:
            found["objective"] = float(model.summary.objectiveHistory[-1])
        return found
    if family == "linear_svm":
        return {"maxIter": float(params.svm_max_iter), "regParam": params.svm_reg}
    if family == "naive_bayes":
        return {"smoothing": params.nb_smoothing}
    return {"numTrees": float(params.rf_trees), "maxDepth": float(params.rf_depth)}


def dealt_by_key(rows: DataFrame, key: str, size: int) -> DataFrame:
    """``rows`` in ranges of the key's digest, about ``size`` rows each and ordered by key.

    The number of ranges follows the number of rows, and a row's range and place follow keys only, so neither
    the input's files nor the cluster changes what a fit sees.
    """
    ranges = max(1, math.ceil(rows.count() / size))
    digest = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10)
    place = F.shiftrightunsigned(digest.cast("long") * F.lit(ranges).cast("long"), 32).cast("int")
    return rows.repartitionById(ranges, place).sortWithinPartitions(key)


def unnamed(df: DataFrame, column: str) -> Column:
    """The vector column with the number of its features only, if all are numeric."""
    given = df.schema[column].metadata.get("ml_attr", {})
    if set(given.get("attrs", {})) - {"numeric"}:
        return F.col(column)
    count = {"ml_attr": {"num_attrs": given["num_attrs"]}} if "num_attrs" in given else {}
    return F.col(column).alias(column, metadata=count)


def class_bounds(train: DataFrame, labels: list[str]) -> dict[str, float]:
    """The labels with a single class, with that class; one narrow job for all labels."""
    bounds = [x for c in labels for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]
    row = train.agg(*bounds).first()
    found = {}
    for c in labels:
        low, high = row[f"lo_{c}"], row[f"hi_{c}"]
        if low is None:
            raise ValueError(f"no training rows for label {c!r}")
        if low == high:
            found[c] = float(low)
    return found


def _can_be_packed(rows: DataFrame, labels: list[str]) -> bool:
    """Whether all features are numeric and all labels 0 or 1."""
    attributes = rows.schema[FEATURES].metadata.get("ml_attr", {}).get("attrs", {})
    odd = [F.max(F.col(c).isNull() | ~F.col(c).isin(0, 1)).alias(c) for c in labels]
    return not set(attributes) - {"numeric"} and not any(rows.agg(*odd).first())


def fit_family(
    train: DataFrame,
    labels: list[str],
    family: str,
    params: TrainParams = TrainParams(),
    *,
    key: str = "example_id",
) -> LabelModels:
    """Fit one model per label, several labels at a time over the same cached rows.

    Rows are dealt by key, as many partitions as their number asks for, so that bagging and summation do not
    depend on the layout of the input; those of a forest do not depend on ``rows_per_partition`` either. The rows of a
    forest are packed once for all labels (``operators.forest``); MLlib fits it where a label or a feature is not as
    that needs it.
    """
    check_family(family)
    constants = class_bounds(train.select(*labels), labels)
    size = BAG_ROWS if family == "random_forest" else params.rows_per_partition
    # Stored without the names of some 60,000 features, which would be sent along with each task of a fit: cached rows
    # take the plan that they come from with them, and there are hundreds of tasks.
    bare = settle(train.select(key, unnamed(train, input_column(family)), *labels), "rows")
    dealt = dealt_by_key(bare, key, size)
    rows = dealt.drop(key).persist(StorageLevel.MEMORY_AND_DISK)
    blocks = None
    try:
        open_labels = [c for c in labels if c not in constants]
        if open_labels and family == "random_forest" and _can_be_packed(rows, open_labels):
            blocks = forest.pack(rows, input_column(family), open_labels, _estimator(family, open_labels[0], params))
            rows.unpersist()

        def fit(label: str):
            estimator = _estimator(family, label, params)
            return label, forest.fit_forest(blocks, label, estimator) if blocks else estimator.fit(rows)

        fitted = {}
        if open_labels:
            threads = max(1, min(params.parallel_fits, len(open_labels)))
            with ThreadPool(threads) as pool:
                fitted = dict(pool.map(inheritable_thread_target(train.sparkSession)(fit), open_labels))
        summaries = {c: _summary(family, m, params) for c, m in fitted.items()}
        return LabelModels(family, list(labels), fitted, constants, summaries)
    finally:
        rows.unpersist()
        if blocks is not None:
            blocks.close()


def margin_model(models: LabelModels) -> LogisticRegressionModel:
    """All fitted labels of a linear family as one matrix; its raw predictions are their margins.

    A row for each label, in order; two for Naive Bayes, one for each class.
    """
    fitted = [models.models[c] for c in models.labels if c in models.models]
    if models.family == "naive_bayes":
        weights = np.vstack([m.theta.toArray() for m in fitted])
        intercepts = np.concatenate([m.pi.toArray() for m in fitted])
    else:
        weights = np.vstack([m.coefficients.toArray() for m in fitted])
        intercepts = np.array([m.intercept for m in fitted])
    return linear_stage(weights, intercepts, input_column(models.family), f"_margins_{models.family}")


def _linear_outputs(
    df: DataFrame, models: LabelModels
) -> tuple[DataFrame, dict[str, tuple[Column, Column, Column]]]:
    fitted = [c for c in models.labels if c in models.models]
    if not fitted:
        return df, {}
    result = margin_model(models).transform(df)
    margins = F.unwrap_udt(f"_margins_{models.family}").getField("values")
    columns = {}
    for i, label in enumerate(fitted):
        if models.family == "naive_bayes":
            negative, raw = F.get(margins, F.lit(2 * i)), F.get(margins, F.lit(2 * i + 1))
            score, positive = 1 / (1 + F.exp(negative - raw)), raw > negative
        else:
            raw = F.get(margins, F.lit(i))
            score, positive = 1 / (1 + F.exp(-raw)), raw > 0
        if models.family == "linear_svm":
            score = F.lit(None).cast("double")
        columns[label] = (score, positive.cast("double"), raw)
    return result, columns


def _stage_outputs(
    df: DataFrame, models: LabelModels
) -> tuple[DataFrame, dict[str, tuple[Column, Column, Column]]]:
    """A stage for each label."""
    result, columns = df, {}
    for label in models.labels:
        if label not in models.models:
            continue
        prefix = f"{models.family}_{label}"
        stage = models.models[label].copy()
        stage.setPredictionCol(f"pred_{prefix}").setRawPredictionCol(f"raw_{prefix}")
        if models.family != "linear_svm":
            stage.setProbabilityCol(f"prob_{prefix}")
        result = stage.transform(result)
        if models.family == "linear_svm":
            score = F.lit(None).cast("double")
        else:
            score = positive_score(result, f"prob_{prefix}")
        columns[label] = (score, F.col(f"pred_{prefix}"), positive_score(result, f"raw_{prefix}"))
    return result, columns


def label_outputs(
    df: DataFrame, models: LabelModels
) -> tuple[DataFrame, dict[str, tuple[Column, Column, Column]]]:
    """``df`` with the outputs of all label models, and per label its (score, pred, raw) columns.

    A linear family is one stage whatever the number of its labels. ``raw`` is the model's raw value for the
    positive class (the margin of an SVM); constants have none.
    """
    outputs = _linear_outputs if models.family in LINEAR else _stage_outputs
    result, columns = outputs(df, models)
    none = F.lit(None).cast("double")
    for label, constant in models.constants.items():
        value = F.lit(constant)
        columns[label] = (none if models.family == "linear_svm" else value, value, none)
    return result, columns


def score_rows(df: DataFrame, models: LabelModels, keep: tuple[str, ...] = ("example_id", "split")) -> DataFrame:
    """Rows of the long score table; feature vectors end here."""
    applied, columns = label_outputs(df, models)
    entries = F.array(
        *[
            F.struct(
                F.lit(label).alias("label"),
                F.lit(i).alias("label_pos"),
                (F.col(label).cast("double") if label in df.columns else F.lit(None).cast("double")).alias("y"),
                columns[label][0].alias("score"),
                columns[label][1].alias("pred"),
                columns[label][2].alias("raw"),
            )
            for i, label in enumerate(models.labels)
        ]
    )
    wide = applied.select(*keep, F.lit(models.family).alias("model"), entries.alias("_labels"))
    return wide.select(*keep, "model", F.inline("_labels")).select(
        *keep, "model", "label", "label_pos", "y", "score", "pred", "raw"
    )


INDEX_SCHEMA = "label_pos int, label string, constant double, summary map<string, double>"


def save_models(models: LabelModels, path: str) -> None:
    """``path/labels/<label>`` per fitted model; label order, constants and summaries in ``path/index``."""
    spark = SparkSession.active()
    for label, model in models.models.items():
        model.write().overwrite().save(f"{path}/labels/{label}")
    rows = [
        (i, label, models.constants.get(label), models.summaries.get(label, {}))
        for i, label in enumerate(models.labels)
    ]
    spark.createDataFrame(rows, INDEX_SCHEMA).coalesce(1).write.mode("overwrite").json(f"{path}/index")


def load_models(spark: SparkSession, path: str, family: str) -> LabelModels:
    check_family(family)
    rows = spark.read.schema(INDEX_SCHEMA).json(f"{path}/index").orderBy("label_pos").collect()
    constants = {r.label: r.constant for r in rows if r.constant is not None}
    loader = MODEL_CLASSES[family]
    models = {
        r.label: loader.load(f"{path}/labels/{r.label}") for r in rows if r.label not in constants
    }
    summaries = {r.label: r.summary for r in rows if r.label in models}
    return LabelModels(family, [r.label for r in rows], models, constants, summaries)


def naive_bayes_parameters(
    entries: DataFrame, examples: DataFrame, vocabulary: DataFrame, labels: list[str], key: str,
    smoothing: float = 1.0,
) -> DataFrame:
    """(label, class, term, theta, pi) of multinomial Naive Bayes for all labels in one job.

    ``entries`` are (key, term, value) rows, ``vocabulary`` the terms. Sums are taken per label,
    class and term before the shuffle, so a class that holds most rows costs no more than others.
    """
    def per_label(df: DataFrame) -> DataFrame:
        pairs = F.array(
            *[F.struct(F.lit(c).alias("label"), F.col(c).cast("int").alias("class")) for c in labels]
        )
        rest = [c for c in df.columns if c not in labels]
        return df.select(*rest, F.inline(pairs))

    sums = (
        per_label(entries.join(examples, key))
        .groupBy("label", "class", "term")
        .agg(F.sum("value").alias("_sum"))
    )
    totals = sums.groupBy("label", "class").agg(F.sum("_sum").alias("_class_sum"))
    docs = per_label(examples.select(*labels)).groupBy("label", "class").agg(
        F.count(F.lit(1)).alias("_docs")
    )
    # At most two rows per label.
    classes = docs.join(F.broadcast(totals), ["label", "class"], "left")
    whole = docs.groupBy("label").agg(
        F.sum("_docs").alias("_all"), F.count(F.lit(1)).alias("_classes")
    )
    classes = classes.join(F.broadcast(whole), "label")
    size = vocabulary.count()
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("label"), F.lit(k).alias("class"))
            for c in labels
            for k in (0, 1)
        ]
    )
    grid = vocabulary.select("term", F.inline(cells))
    full = grid.join(F.broadcast(classes), ["label", "class"]).join(
        sums, ["label", "class", "term"], "left"
    )
    smooth = F.lit(float(smoothing))
    theta = F.ln(F.coalesce("_sum", F.lit(0.0)) + smooth) - F.ln(
        F.coalesce("_class_sum", F.lit(0.0)) + smooth * F.lit(float(size))
    )
    pi = F.ln(F.col("_docs") + smooth) - F.ln(F.col("_all") + smooth * F.col("_classes"))
    return full.select("label", "class", "term", theta.alias("theta"), pi.alias("pi"))
