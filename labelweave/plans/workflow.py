"""The whole training job: features, models, ensemble, thresholds, metrics, samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.operators.annotate import label_array, prepare_examples, primary_label
from labelweave.operators.features import FeatureModel, FeatureParams, fit_features
from labelweave.operators.metrics import evaluate
from labelweave.operators.scores import ENSEMBLE, canonical_predictions, majority_vote
from labelweave.operators.split import (
    ensure_partitions,
    hash_split,
    sample_rows,
    split_counts,
    stratified_split,
)
from labelweave.operators.thresholds import setting, tune_thresholds
from labelweave.operators.train import (
    COUNTS,
    FAMILIES,
    FEATURES,
    TrainParams,
    check_family,
    family_settings,
    fit_family,
    load_models,
    save_models,
    score_rows,
)
from labelweave.sources import artifacts
from labelweave.sources.annotations import read_annotation_csv
from labelweave.sources.lexicons import read_emotion_lexicon, vad_or_empty
from labelweave.taxonomy import THRESHOLD_GRID, Taxonomy


@dataclass(frozen=True)
class WorkflowParams:
    families: tuple[str, ...] = tuple(FAMILIES)
    features: FeatureParams = FeatureParams()
    training: TrainParams = TrainParams()
    ratios: tuple[float, float, float] = (0.70, 0.15, 0.15)
    stratify: bool = True
    seed: int = 42
    partitions: int | None = None
    land: bool = True
    buckets: int | None = None
    include_train: bool = True
    save_features: bool = True
    auto_tune: bool = True
    candidates: tuple[float, ...] = tuple(THRESHOLD_GRID)
    thresholds: Mapping[str, float] = field(default_factory=dict)
    sample_size: int = 15


@dataclass
class WorkflowResult:
    """Tables of a run; all are read back from ``out``."""

    out: str
    resumed: list[str]
    counts: DataFrame
    scores: DataFrame
    thresholds: DataFrame
    summary: DataFrame
    per_label: DataFrame
    samples: str | None
    skipped: list[str]


def assign_splits(examples: DataFrame, labels: Sequence[str], params: WorkflowParams) -> DataFrame:
    """Add ``split`` to ``example_id, text, <labels>`` rows."""
    if not params.stratify:
        return hash_split(examples, "example_id", params.ratios, seed=params.seed)
    ready = examples.withColumn("_primary", primary_label(list(labels)))
    return stratified_split(ready, "example_id", "_primary", params.ratios, seed=params.seed).drop(
        "_primary"
    )


def _train_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col("split") == "train")


def _land_examples(examples: DataFrame, path: str, table: str, params: WorkflowParams) -> DataFrame:
    if params.buckets:
        return artifacts.land_clustered(examples, path, table, "example_id", params.buckets)
    examples.write.mode("overwrite").parquet(path)
    return examples.sparkSession.read.schema(examples.schema).parquet(path)


def _open_examples(spark: SparkSession, path: str, table: str, params: WorkflowParams) -> DataFrame | None:
    if params.buckets:
        return artifacts.open_clustered(spark, path, table, "example_id", params.buckets)
    return artifacts.read_if_present(spark, path)


def check_keys(examples: DataFrame) -> None:
    """Raise if an ``example_id`` is missing or repeated; one aggregate over the keys."""
    artifacts.keyed_digest(examples.select("example_id"), "example_id")


def _digested(
    spark: SparkSession, given: DataFrame, out: str, table: str, manifest: artifacts.Manifest, params: WorkflowParams
) -> tuple[DataFrame, str]:
    """The examples and the digest of their rows; each key is checked.

    A first run computes ``given`` once, to land it; keys and digest come from one pass over what has landed. A
    later run takes them from ``given`` and lands it only if its rows are new.
    """
    layout = [params.buckets, params.partitions]
    if not params.land:
        return given, artifacts.fingerprint(artifacts.keyed_digest(given, "example_id"), layout)
    path = f"{out}/examples"
    before = manifest.finished("examples")
    if before is not None:
        digest = artifacts.fingerprint(artifacts.keyed_digest(given, "example_id"), layout)
        landed = _open_examples(spark, path, table, params) if digest == before else None
        if landed is not None:
            return landed, digest
    manifest.open("examples")
    landed = _land_examples(ensure_partitions(given, params.partitions), path, table, params)
    digest = artifacts.fingerprint(artifacts.keyed_digest(landed, "example_id"), layout)
    manifest.close("examples", digest)
    return landed, digest


def run_workflow(
    spark: SparkSession,
    examples: DataFrame,
    labels: Sequence[str],
    out: str,
    *,
    pairs: DataFrame,
    vad: DataFrame,
    emotions: Sequence[str],
    params: WorkflowParams = WorkflowParams(),
) -> WorkflowResult:
    """Train, score, tune and evaluate; everything lands under ``out``.

    ``examples`` has a unique ``example_id``, a ``text`` and one 0/1 column per label. ``vad`` may be empty, its
    features are then 0. A missing or repeated ``example_id`` raises an error.

    A manifest names each stage by a digest of its own inputs and settings: examples, features, and the models of
    each family. A second call reuses the stages whose digest is the same, also those of a run that was killed,
    and the scores of finished splits; a family's changed setting fits that family again and nothing else, other
    rows or feature settings start over, and nothing of the earlier run stays.

    The split reads the examples three times, so they are landed first. Set ``land=False`` when they
    are a plain scan of stored files, and ``buckets`` to land them clustered by key.
    """
    labels = list(labels)
    for family in params.families:
        check_family(family)
    manifest = artifacts.Manifest(spark, f"{out}/manifest")
    table = f"labelweave_examples_{artifacts.fingerprint(out)[:12]}"
    given = examples.select("example_id", "text", *labels)
    landed, rows_digest = _digested(spark, given, out, table, manifest, params)
    lexica = [artifacts.content_digest(lexicon) for lexicon in (pairs, vad)]
    features_digest = artifacts.fingerprint(
        rows_digest, labels, list(emotions), lexica, params.features, params.ratios, params.stratify, params.seed
    )
    resumed: list[str] = []
    feature_rows = model = None
    if manifest.holds("features", features_digest):
        feature_rows = artifacts.read_if_present(spark, f"{out}/features")
    if feature_rows is not None:
        resumed.append("features")
        model = FeatureModel.load(spark, f"{out}/models/features")
    else:
        manifest.open("features")
        for family in FAMILIES:
            manifest.open(family)
        artifacts.clear_scores(spark, f"{out}/scores")
        divided = assign_splits(landed, labels, params)
        artifacts.write_splits(
            divided.filter(F.col("split") == "test").select("example_id", "text", *labels, "split"),
            f"{out}/holdout",
        )
        model = fit_features(_train_rows(divided), pairs, vad, list(emotions), params.features)
        model.save(f"{out}/models/features")
        model = FeatureModel.load(spark, f"{out}/models/features")
        measured = model.measure(divided).withColumn("label_array", label_array(labels))
        if params.save_features:
            artifacts.write_splits(measured.drop("text"), f"{out}/features")
            feature_rows = artifacts.read_if_present(spark, f"{out}/features")
            manifest.close("features", features_digest)
        else:
            # Features that were not saved cannot be resumed.
            feature_rows = measured.drop("text")

    scores_path = f"{out}/scores"
    wanted = {row["split"] for row in feature_rows.select("split").distinct().collect()}
    if not params.include_train:
        wanted.discard("train")
    plain = model.assemble(feature_rows, FEATURES)
    counts = model.assemble(feature_rows, COUNTS, non_negative=True)
    for family in params.families:
        rows = counts if family == "naive_bayes" else plain
        digest = artifacts.fingerprint(features_digest, family, family_settings(family, params.training))
        if manifest.holds(family, digest):
            resumed.append(family)
            fitted = None
        else:
            # Scores are written after their models are finished, so those that are there vouch for these.
            manifest.open(family)
            artifacts.drop_scores(spark, scores_path, family)
            fitted = fit_family(_train_rows(rows), labels, family, params.training)
            save_models(fitted, f"{out}/models/{family}")
            manifest.close(family, digest)
        scored = {split for name, split in artifacts.folders(spark, scores_path, "model", "split") if name == family}
        missing = sorted(wanted - scored)
        if missing:
            fitted = fitted or load_models(spark, f"{out}/models/{family}", family)
            artifacts.write_scores(score_rows(rows.filter(F.col("split").isin(missing)), fitted), scores_path)

    families = list(params.families)
    skipped = []
    base = artifacts.read_scores(spark, scores_path).filter(F.col("model").isin(families))
    if len(families) > 1:
        artifacts.write_scores(majority_vote(base, families), scores_path)
        families.append(ENSEMBLE)
    else:
        skipped.append(ENSEMBLE)
    scores = artifacts.read_scores(spark, scores_path).filter(F.col("model").isin(families))
    if not params.include_train:
        scores = scores.filter(F.col("split") != "train")

    if params.auto_tune:
        tuned = tune_thresholds(
            scores.filter(F.col("split") == "validation"), params.candidates, params.thresholds,
            scores.select("model", "label"),
        )
    else:
        configured = F.coalesce(setting(params.thresholds, F.col("label")), F.lit(0.5))
        tuned = scores.select("model", "label").distinct().select(
            "model", "label", configured.alias("threshold")
        )
    artifacts.write_thresholds(tuned, f"{out}/thresholds")
    artifacts.write_families(spark, list(params.families), f"{out}/families")
    thresholds = artifacts.read_thresholds(spark, f"{out}/thresholds")
    summary, per_label = evaluate(canonical_predictions(scores, thresholds))
    artifacts.write_metrics(summary, per_label, f"{out}/metrics")

    samples = None
    if params.sample_size > 0:
        samples = f"{out}/samples"
        holdout = artifacts.read_holdout(spark, f"{out}/holdout")
        if holdout is None:
            # Features are kept without texts; those of the test rows come from the examples.
            test_keys = feature_rows.filter(F.col("split") == "test").select("example_id")
            holdout = landed.join(test_keys, "example_id")
        picked = sample_rows(holdout, "example_id", params.sample_size, params.seed)
        artifacts.write_samples(picked.select("text", *labels), samples)

    return WorkflowResult(
        out, resumed, split_counts(feature_rows), scores, thresholds, summary, per_label,
        samples, skipped,
    )


def run_from_files(
    spark: SparkSession,
    shards: Sequence[str],
    emotion_lexicon: str,
    vad_lexicon: str | None,
    out: str,
    *,
    taxonomy: Taxonomy = Taxonomy(),
    sample_fraction: float | None = None,
    params: WorkflowParams | None = None,
) -> tuple[WorkflowResult, bool]:
    """The whole job from annotation shards and lexicon files.

    The flag tells whether the VAD lexicon could be read; without it its features are 0.
    """
    if params is None:
        params = WorkflowParams(thresholds=taxonomy.thresholds)
    annotations = read_annotation_csv(spark, shards)
    examples = prepare_examples(
        annotations, taxonomy, sample_fraction=sample_fraction, seed=params.seed
    )
    vad, available = vad_or_empty(spark, vad_lexicon)
    result = run_workflow(
        spark,
        examples,
        taxonomy.labels,
        out,
        pairs=read_emotion_lexicon(spark, emotion_lexicon),
        vad=vad,
        emotions=taxonomy.emotions,
        params=params,
    )
    return result, available
