"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.catalog import fixtures as fx
from labelweave.catalog.fixtures import TAXONOMY
from labelweave.functions import narrative
from labelweave.functions.keys import with_example_id
from labelweave.functions.text import (
    drop_stop_words,
    english_stop_words,
    style_measures,
    tokenize,
    word_ngrams,
)
from labelweave.operators import annotate, lexicon, metrics, scores, split, thresholds, train
from labelweave.operators import vocabulary as vocab
from labelweave.operators.features import (
    FeatureModel,
    clip_non_negative,
    feature_dims,
    fit_features,
    vector_rows,
    with_tokens,
)
from labelweave.plans.scoring import ScoringBundle, score_table
from labelweave.plans.workflow import WorkflowParams, run_from_files, run_workflow
from labelweave.scratch import scratch_path, settle
from labelweave.sources import annotations as csv_source
from labelweave.sources import artifacts, lexicons
from labelweave.taxonomy import THRESHOLD_GRID

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
LABELS = TAXONOMY.labels
BASE_MODELS = [name for name, _, _ in fx.FIXTURE_MODELS]
QUALITY_LABELS = ["quality", "toxic"]


def query(run: Query) -> Query:
    REGISTRY[run.__name__.removesuffix("_query")] = run
    return run


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    wanted = set(names)
    return df.select(*[F.round(c, digits).alias(c) if c in wanted else F.col(c) for c in df.columns])


# Sources, projections, rater aggregation


def _csv_shards(spark: SparkSession, sf: str) -> list[str]:
    """One CSV shard per rater, with the texts of all documents."""
    rows = fx.annotations(spark, sf)
    root = scratch_path(spark, "shards")
    paths = [f"{root}/shard{i}" for i in range(3)]
    for i, path in enumerate(paths):
        csv_source.write_annotation_csv(rows.filter(F.col("rater") == i).drop("rater"), path)
    return paths


def _lexicon_files(spark: SparkSession, sf: str) -> tuple[str, str]:
    emotions, vad = scratch_path(spark, "emotions"), scratch_path(spark, "vad")
    fx.emotion_rows(spark, sf).write.option("sep", "\t").csv(emotions)
    fx.vad_lexicon(spark, sf).toDF("Term", " Valence", "AROUSAL", "Dominance").write.option(
        "sep", "\t"
    ).option("header", True).csv(vad)
    return emotions, vad


@query
def csv_shard_union(spark: SparkSession, sf: str) -> DataFrame:
    back = csv_source.read_annotation_csv(spark, _csv_shards(spark, sf))
    return annotate.cast_labels(
        back.select("id", "text", "example_very_unclear", *TAXONOMY.fine), TAXONOMY.fine
    )


@query
def lexicon_tsv_scan(spark: SparkSession, sf: str) -> DataFrame:
    return lexicons.read_emotion_lexicon(spark, _lexicon_files(spark, sf)[0])


@query
def vad_scan_normalized(spark: SparkSession, sf: str) -> DataFrame:
    return lexicons.read_vad_lexicon(spark, _lexicon_files(spark, sf)[1])


@query
def filter_unclear(spark: SparkSession, sf: str) -> DataFrame:
    return annotate.filter_unclear(fx.annotations(spark, sf)).select("id", "rater")


@query
def rater_max(spark: SparkSession, sf: str) -> DataFrame:
    return fx.collapsed(spark, sf)


@query
def taxonomy_projection(spark: SparkSession, sf: str) -> DataFrame:
    return fx.coarse(spark, sf)


@query
def primary_label(spark: SparkSession, sf: str) -> DataFrame:
    return fx.coarse(spark, sf, text=False).select(
        "id", annotate.primary_label(LABELS).alias("primary_label")
    )


@query
def label_array(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.coarse(spark, sf, text=False).select("id", annotate.label_array(LABELS).alias("labels"))
    return rows.select("id", F.posexplode("labels").alias("label_pos", "value"))


@query
def prepared_examples(spark: SparkSession, sf: str) -> DataFrame:
    return annotate.prepare_examples(fx.annotations(spark, sf), TAXONOMY)


# Splits and samples


@query
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return fx.stratified(spark, sf).select("id", "primary_label", "split")


@query
def stratified_split_bucketed(spark: SparkSession, sf: str) -> DataFrame:
    labelled = fx.coarse(spark, sf, text=False).select(
        "id", annotate.primary_label(LABELS).alias("primary_label")
    )
    ranks = split.percent_ranks(settle(labelled, "examples"), "id", "primary_label")
    part = (
        F.when(F.col("rank") <= 0.70, "train")
        .when(F.col("rank") <= 0.70 + 0.15, "validation")
        .otherwise("test")
    )
    return ranks.withColumn("split", part)


@query
def hash_split(spark: SparkSession, sf: str) -> DataFrame:
    return split.hash_split(fx.table(spark, sf, "documents").select("doc_id"), "doc_id")


@query
def hash_sample(spark: SparkSession, sf: str) -> DataFrame:
    return split.hash_sample(fx.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 0.25)


@query
def split_counts(spark: SparkSession, sf: str) -> DataFrame:
    return split.split_counts(fx.stratified(spark, sf), "primary_label")


@query
def sample_rows(spark: SparkSession, sf: str) -> DataFrame:
    test = fx.stratified(spark, sf, text=True).filter(F.col("split") == "test")
    return split.sample_rows(test, "id", 15).select("text", *LABELS)


# Texts


@query
def tokens(spark: SparkSession, sf: str) -> DataFrame:
    docs = fx.texts(spark, sf)
    return docs.select("doc_id", F.array_join(tokenize(F.col("text")), " ").alias("tokens"))


@query
def filtered_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return with_tokens(fx.texts(spark, sf)).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@query
def ngrams(spark: SparkSession, sf: str) -> DataFrame:
    docs = with_tokens(fx.texts(spark, sf)).select("doc_id", "tokens")
    bags = F.array(
        *[
            F.struct(F.lit(n).alias("n"), word_ngrams(F.col("tokens"), n).alias("grams"))
            for n in (2, 3)
        ]
    )
    rows = docs.select("doc_id", F.inline(bags))
    return rows.select(
        "doc_id", "n", F.size("grams").alias("size"), F.array_join("grams", "|").alias("grams")
    )


_RATIOS = ["avg_word_length", "title_case_ratio", "uppercase_char_ratio", "punctuation_density"]


@query
def linguistic_features(spark: SparkSession, sf: str) -> DataFrame:
    docs = with_tokens(fx.texts(spark, sf))
    return rounded(docs.select("doc_id", *style_measures(F.col("text"), F.col("tokens"))), *_RATIOS)


@query
def linguistic_features_raw_case(spark: SparkSession, sf: str) -> DataFrame:
    docs = with_tokens(fx.texts(spark, sf))
    raw = drop_stop_words(
        tokenize(F.col("text"), lowercase=False), english_stop_words(), lowercase=False
    )
    docs = docs.withColumn("raw", raw)
    measures = style_measures(F.col("text"), F.col("tokens"), raw_tokens=F.col("raw"))
    return rounded(docs.select("doc_id", *measures), *_RATIOS)


@query
def lexicon_term_sets(spark: SparkSession, sf: str) -> DataFrame:
    sets = lexicons.emotion_sets(fx.emotion_lexicon(spark, sf))
    return sets.select("term", F.array_join("emotions", ",").alias("emotions"))


_LEX_RATIOS = [f"lex_ratio_{e}" for e in TAXONOMY.emotions] + ["lex_total_ratio"]


def _token_table(spark: SparkSession, sf: str) -> DataFrame:
    return with_tokens(fx.texts(spark, sf)).select("doc_id", "tokens")


@query
def lexicon_features(spark: SparkSession, sf: str) -> DataFrame:
    measured = lexicon.lexicon_measures(
        _token_table(spark, sf), fx.emotion_lexicon(spark, sf), "doc_id", "tokens", TAXONOMY.emotions
    )
    return rounded(measured, *_LEX_RATIOS)


@query
def vad_features(spark: SparkSession, sf: str) -> DataFrame:
    measured = lexicon.vad_measures(
        _token_table(spark, sf), fx.vad_lexicon(spark, sf), "doc_id", "tokens"
    )
    return rounded(measured, *lexicon.vad_features())


def _vocabulary(n: int) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        learned = vocab.vocabularies(_token_table(spark, sf), "tokens", [n])
        return learned.select("term", "occurrences", "documents", "index")

    return run


for _n in (1, 2, 3):
    REGISTRY[f"vocabulary_{_n}gram"] = _vocabulary(_n)


@query
def idf_weights(spark: SparkSession, sf: str) -> DataFrame:
    learned = vocab.vocabularies(_token_table(spark, sf), "tokens", [1, 2, 3])
    return rounded(learned.select("n", "term", "idf"), "idf")


@query
def tfidf_long(spark: SparkSession, sf: str) -> DataFrame:
    docs = _token_table(spark, sf)
    learned = settle(vocab.vocabularies(docs, "tokens", [1]), "vocabulary")
    return rounded(vocab.tfidf_rows(docs, "doc_id", "tokens", learned, 1), "tfidf")


@query
def tfidf_long_all(spark: SparkSession, sf: str) -> DataFrame:
    """``tfidf_long`` for all orders."""
    docs = _token_table(spark, sf)
    learned = settle(vocab.vocabularies(docs, "tokens", [1, 2, 3]), "vocabulary")
    rows = [
        vocab.tfidf_rows(docs, "doc_id", "tokens", learned, n).select("doc_id", F.lit(n).alias("n"), "term", "tf", "tfidf")
        for n in (1, 2, 3)
    ]
    return rounded(reduce(DataFrame.unionByName, rows), "tfidf")


# Feature table and training


def _fitted(spark: SparkSession, sf: str) -> tuple[DataFrame, FeatureModel]:
    examples = fx.labelled_documents(spark, sf)
    model = fit_features(
        examples.filter(F.col("split") == "train"),
        fx.emotion_lexicon(spark, sf),
        fx.vad_lexicon(spark, sf),
        TAXONOMY.emotions,
    )
    return examples, model


@query
def feature_dims_query(spark: SparkSession, sf: str) -> DataFrame:
    examples, model = _fitted(spark, sf)
    return feature_dims(model, model.transform(examples))


def _rounded_features(model: FeatureModel, examples: DataFrame) -> DataFrame:
    sums = [
        F.round(
            F.aggregate(F.unwrap_udt(c).getField("values"), F.lit(0.0), lambda a, v: a + v), 5
        ).alias(f"{c}_sum")
        for c in model.tfidf_columns
    ]
    plain = rounded(model.measure(examples), *_LEX_RATIOS, *lexicon.vad_features(), *_RATIOS)
    return plain.select("example_id", "split", *sums, *model.scalar_columns)


def _every_document(spark: SparkSession, sf: str, examples: DataFrame) -> DataFrame:
    """All documents; those without a label have no split."""
    docs = fx.texts(spark, sf).withColumnRenamed("doc_id", "example_id")
    return docs.join(examples.select("example_id", "split"), "example_id", "left")


@query
def feature_table(spark: SparkSession, sf: str) -> DataFrame:
    """Features of all documents, by the model of the labelled train rows."""
    examples, model = _fitted(spark, sf)
    return _rounded_features(model, _every_document(spark, sf, examples))


@query
def feature_model_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    examples, model = _fitted(spark, sf)
    path = scratch_path(spark, "feature_model")
    model.save(path)
    return _rounded_features(FeatureModel.load(spark, path), _every_document(spark, sf, examples))


# The names under which the whole tables were first given.
REGISTRY["feature_table_all"] = feature_table
REGISTRY["feature_model_roundtrip_all"] = feature_model_roundtrip


@query
def assembled_vector(spark: SparkSession, sf: str) -> DataFrame:
    """Every entry of the vectors of all documents, by its place and its name in the vector's metadata."""
    examples, model = _fitted(spark, sf)
    rows = vector_rows(model.transform(_every_document(spark, sf, examples)), "example_id")
    value = F.when(F.col("name").startswith("tfidf_"), F.round("value", 5)).otherwise(F.round("value", 6))
    return rows.withColumn("value", value)


@query
def clip_non_negative_query(spark: SparkSession, sf: str) -> DataFrame:
    measured = lexicon.lexicon_measures(
        _token_table(spark, sf), fx.emotion_lexicon(spark, sf), "doc_id", "tokens", TAXONOMY.emotions
    )
    return measured.select(
        "doc_id",
        F.col("lex_dominant_index").alias("raw_index"),
        *clip_non_negative(["lex_dominant_index", "lex_total_matches"]),
    )


@query
def naive_bayes_parameters(spark: SparkSession, sf: str) -> DataFrame:
    examples = with_tokens(fx.labelled_documents(spark, sf).filter(F.col("split") == "train"))
    learned = settle(vocab.vocabularies(examples, "tokens", [1]), "vocabulary")
    entries = vocab.tfidf_rows(examples, "example_id", "tokens", learned, 1).select(
        "example_id", "term", F.col("tf").alias("value")
    )
    marks = examples.select("example_id", *QUALITY_LABELS)
    found = train.naive_bayes_parameters(entries, marks, learned, QUALITY_LABELS, "example_id")
    return rounded(found, "theta", "pi")


def _trained(spark: SparkSession, sf: str, family: str) -> tuple[DataFrame, train.LabelModels]:
    """Assembled features of the labelled documents and one model per label."""
    examples, model = _fitted(spark, sf)
    vectors = model.assemble(
        model.measure(examples), train.input_column(family), non_negative=family == "naive_bayes"
    )
    ready = settle(vectors, "features")
    fitted = train.fit_family(ready.filter(F.col("split") == "train"), QUALITY_LABELS, family)
    return ready, fitted


def _rounded_scores(df: DataFrame) -> DataFrame:
    return rounded(rounded(df, "score"), "raw", digits=4)


def _trained_scores(family: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _rounded_scores(train.score_rows(*_trained(spark, sf, family)))

    return run


for _name, _family in {
    "scores_logistic": "logistic_regression",
    "scores_svm": "linear_svm",
    "scores_bayes": "naive_bayes",
    "scores_forest": "random_forest",
}.items():
    REGISTRY[_name] = _trained_scores(_family)


@query
def label_models_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    ready, fitted = _trained(spark, sf, "naive_bayes")
    path = scratch_path(spark, "models")
    train.save_models(fitted, path)
    return _rounded_scores(train.score_rows(ready, train.load_models(spark, path, "naive_bayes")))


# Scores, thresholds, metrics


@query
def prediction_join(spark: SparkSession, sf: str) -> DataFrame:
    return scores.prediction_join(fx.scores(spark, sf), BASE_MODELS)


@query
def prediction_join_by_text(spark: SparkSession, sf: str) -> DataFrame:
    """``prediction_join`` of scores that have texts in place of keys; of equal texts the first example is taken."""
    docs = fx.table(spark, sf, "documents").filter(F.col("text").isNotNull())
    first = docs.groupBy("text").agg(F.min("doc_id").alias("example_id"))
    keyless = fx.scores(spark, sf).join(first, "example_id").drop("example_id")
    return scores.prediction_join(keyless, BASE_MODELS)


@query
def majority_vote(spark: SparkSession, sf: str) -> DataFrame:
    return scores.majority_vote(fx.scores(spark, sf), BASE_MODELS)


def _with_votes(spark: SparkSession, sf: str) -> DataFrame:
    base = settle(fx.scores(spark, sf), "scores")
    votes = settle(scores.majority_vote(base, BASE_MODELS), "votes")
    return base.unionByName(votes)


def _validation(every: DataFrame) -> DataFrame:
    return every.filter(F.col("split") == "validation")


_PRF = ["precision", "recall", "f1"]


@query
def threshold_grid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(thresholds.threshold_grid(_validation(_with_votes(spark, sf)), THRESHOLD_GRID), *_PRF)


@query
def best_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    grid = thresholds.threshold_grid(_validation(_with_votes(spark, sf)), THRESHOLD_GRID)
    return rounded(thresholds.best_thresholds(grid), *_PRF)


def _tuned(every: DataFrame) -> DataFrame:
    return thresholds.tune_thresholds(_validation(every), THRESHOLD_GRID, TAXONOMY.thresholds)


@query
def tuned_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return _tuned(_with_votes(spark, sf))


@query
def resolved_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    tuned = settle(_tuned(_with_votes(spark, sf)), "thresholds")
    mixed = thresholds.resolve_thresholds(tuned, overrides={"fear": 0.25, "unknown": 0.9})
    based = thresholds.resolve_thresholds(tuned, base=0.6, overrides={"fear": 0.25})
    return mixed.withColumn("mode", F.lit("overrides")).unionByName(
        based.withColumn("mode", F.lit("base"))
    )


def _decided(spark: SparkSession, sf: str) -> DataFrame:
    every = _with_votes(spark, sf)
    return scores.canonical_predictions(every, settle(_tuned(every), "thresholds"))


@query
def canonical_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return _decided(spark, sf)


@query
def prediction_columns(spark: SparkSession, sf: str) -> DataFrame:
    return scores.prediction_columns(_decided(spark, sf), LABELS)


@query
def prediction_texts(spark: SparkSession, sf: str) -> DataFrame:
    """``prediction_columns`` with the text of each example."""
    texts = fx.texts(spark, sf).withColumnRenamed("doc_id", "example_id")
    return scores.prediction_columns(_decided(spark, sf), LABELS, texts)


@query
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion(_decided(spark, sf))


@query
def per_label_metrics(spark: SparkSession, sf: str) -> DataFrame:
    table = metrics.per_label_metrics(metrics.confusion(_decided(spark, sf)))
    return rounded(table.select("model", "split", "label", "support", *_PRF), *_PRF)


_AVERAGES = [f"{kind}_{name}" for kind in ("micro", "macro") for name in _PRF]


@query
def micro_macro_metrics(spark: SparkSession, sf: str) -> DataFrame:
    table = metrics.per_label_metrics(metrics.confusion(_decided(spark, sf)))
    return rounded(metrics.micro_macro_metrics(table), *_AVERAGES)


@query
def hamming_loss(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.hamming_loss(metrics.confusion(_decided(spark, sf))), "hamming_loss")


@query
def subset_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.subset_accuracy(_decided(spark, sf)), "subset_accuracy")


@query
def evaluation_summary(spark: SparkSession, sf: str) -> DataFrame:
    summary, _ = metrics.evaluate(_decided(spark, sf))
    names = [
        "micro_precision", "micro_recall", "micro_f1", "macro_precision", "macro_recall", "macro_f1",
        "hamming_loss", "subset_accuracy",
    ]
    return rounded(summary.select("model", "split", *names), *names)


def _summaries(spark: SparkSession, sf: str) -> DataFrame:
    return narrative.gather_labels(_decided(spark, sf), "example_id", "model")


@query
def top_labels(spark: SparkSession, sf: str) -> DataFrame:
    best = narrative.top_labels(F.col("predictions"), 5)
    return _summaries(spark, sf).select("example_id", "model", F.array_join(best, ",").alias("top_labels"))


@query
def positive_labels(spark: SparkSession, sf: str) -> DataFrame:
    found = narrative.positive_labels(F.col("predictions"))
    return _summaries(spark, sf).select(
        "example_id", "model", F.array_join(found, ",").alias("positive_labels")
    )


@query
def story(spark: SparkSession, sf: str) -> DataFrame:
    sentence = narrative.story(F.col("predictions"), TAXONOMY.descriptors)
    return _summaries(spark, sf).select("example_id", "model", sentence.alias("story"))


# Saved tables


@query
def split_table_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "splits")
    artifacts.write_splits(fx.stratified(spark, sf).select("id", "primary_label", "split"), path)
    return artifacts.read_if_present(spark, path)


@query
def scores_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "scores")
    artifacts.write_scores(fx.scores(spark, sf), path)
    return artifacts.read_scores(spark, path)


@query
def thresholds_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "thresholds")
    artifacts.write_thresholds(_tuned(_with_votes(spark, sf)), path)
    return artifacts.read_thresholds(spark, path)


@query
def metrics_json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "metrics")
    artifacts.write_metrics(*metrics.evaluate(_decided(spark, sf)), path)
    rows = spark.read.json(path).select("model", "dataset", F.explode("per_label").alias("entry"))
    return rounded(rows.select("model", "dataset", "entry.*"), *_PRF)


@query
def sample_texts_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "samples")
    artifacts.write_samples(sample_rows(spark, sf), path)
    return artifacts.read_sample_texts(spark, path)


# Whole jobs


def _workflow(spark: SparkSession, sf: str, out: str):
    examples = fx.labelled_documents(spark, sf).drop("split")
    return run_workflow(
        spark,
        examples,
        QUALITY_LABELS,
        out,
        pairs=fx.emotion_lexicon(spark, sf),
        vad=fx.vad_lexicon(spark, sf),
        emotions=TAXONOMY.emotions,
        params=WorkflowParams(),
    )


@query
def workflow_metrics(spark: SparkSession, sf: str) -> DataFrame:
    result = _workflow(spark, sf, scratch_path(spark, "run"))
    return result.summary


@query
def train_from_files(spark: SparkSession, sf: str) -> DataFrame:
    emotions, vad = _lexicon_files(spark, sf)
    params = WorkflowParams(thresholds=TAXONOMY.thresholds)
    result, _ = run_from_files(
        spark, _csv_shards(spark, sf), emotions, vad, scratch_path(spark, "run"), params=params
    )
    return result.per_label


@query
def resume_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    out = scratch_path(spark, "run")
    _workflow(spark, sf, out)
    again = _workflow(spark, sf, out)
    return _rounded_scores(again.scores.filter(F.col("model") == "naive_bayes"))


@query
def score_table_query(spark: SparkSession, sf: str) -> DataFrame:
    out = scratch_path(spark, "run")
    _workflow(spark, sf, out)
    bundle = ScoringBundle.load(spark, out)
    docs = with_example_id(fx.texts(spark, sf), ["doc_id"]).select("example_id", "text")
    scored = score_table(docs, bundle, model=scores.ENSEMBLE)
    return scored.select(
        "example_id",
        F.array_join("positive_labels", ",").alias("positive_labels"),
        F.array_join("top_labels", ",").alias("top_labels"),
        "story",
    )
