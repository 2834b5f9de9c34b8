"""The feature table: TF-IDF blocks, lexicon, VAD and style columns, assembled for MLlib."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import (
    ElementwiseProduct,
    NGram,
    RegexTokenizer,
    StopWordsRemover,
    VectorAssembler,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.functions.text import (
    STYLE_FEATURES,
    drop_stop_words,
    english_stop_words,
    style_measures,
    tokenize,
)
from labelweave.operators.lexicon import (
    TermWeights,
    lexicon_features,
    row_measures,
    term_measures,
    term_table,
    term_weights,
    vad_features,
)
from labelweave.operators.lookup import broadcast_if_small
from labelweave.operators.vocabulary import term_counter, vocabularies
from labelweave.scratch import settle

#: The block of lexicon term counts.
TERM_COUNTS = "_term_counts"


@dataclass(frozen=True)
class FeatureParams:
    max_vocab: int = 20_000
    min_df: int = 5
    ngram_orders: tuple[int, ...] = (1, 2, 3)
    idf_min_doc_freq: int = 1

    @property
    def orders(self) -> list[int]:
        return sorted(set(self.ngram_orders)) or [1, 2, 3]


def with_tokens(df: DataFrame, text: str = "text", output: str = "tokens") -> DataFrame:
    """Filtered, lower-cased tokens as a column."""
    words = english_stop_words()
    return df.withColumn(output, drop_stop_words(tokenize(F.col(text)), words))


def clip_non_negative(names: list[str]) -> list[Column]:
    """The columns with negative values set to 0, for models that accept counts only."""
    return [F.greatest(F.col(name), F.lit(0.0)).alias(name) for name in names]


@dataclass
class FeatureModel:
    """A fitted text-to-columns transformation; ``terms`` stays a table.

    ``weights`` are those of ``terms`` if their counts are a block of the text stages, else None.
    """

    text_stages: PipelineModel
    terms: DataFrame
    orders: list[int]
    emotions: list[str]
    weights: TermWeights | None = None

    @property
    def tfidf_columns(self) -> list[str]:
        return [f"tfidf_{n}gram" for n in self.orders]

    @property
    def scalar_columns(self) -> list[str]:
        return [*lexicon_features(self.emotions), *vad_features(), *STYLE_FEATURES]

    def measure(self, df: DataFrame) -> DataFrame:
        """``df`` plus TF-IDF vectors and 55 scalar columns, row by row; keys may be missing or repeated.

        All measures come from the row's own text: one scan, no join, no shuffle. A lexicon without weights
        in the model is joined instead, by a number given to each row.
        """
        # A missing text is measured as an empty one and stays missing in the output.
        filled = df.withColumn("_given", F.col("text")).withColumn("text", F.coalesce("text", F.lit("")))
        staged = self.text_stages.transform(filled)
        style = style_measures(F.col("text"), F.col("_filtered"))
        given = [F.col("_given").alias("text") if c == "text" else F.col(c) for c in df.columns]
        output = [*df.columns, *self.tfidf_columns, *self.scalar_columns]
        keep = [*df.columns, *self.tfidf_columns, *STYLE_FEATURES]
        if self.weights is not None:
            rows = staged.select(*given, *self.tfidf_columns, *style, "_filtered", TERM_COUNTS)
            tokens = F.size("_filtered")
            return row_measures(rows, TERM_COUNTS, tokens, self.weights, self.emotions, keep).select(*output)
        numbered = staged.select(*given, *self.tfidf_columns, *style, "_filtered", F.monotonically_increasing_id().alias("_row"))
        # Stored, so that both sides of the join agree on the numbers.
        rows = settle(numbered, "measured")
        by_row = term_measures(rows.select("_row", "_filtered"), self.terms, "_row", "_filtered", self.emotions)
        return rows.select("_row", *keep).join(by_row, "_row").select(*output)

    def add_vector(
        self, measured: DataFrame, output: str = "features", *, non_negative: bool = False
    ) -> DataFrame:
        """Add one vector per row: TF-IDF blocks, lexicon, VAD, style. A map-only step."""
        scalars = self.scalar_columns
        source = measured
        if non_negative:
            # TF-IDF values are never negative, so only the scalars need clipping.
            scalars = [f"_clipped_{c}" for c in self.scalar_columns]
            clipped = zip(clip_non_negative(self.scalar_columns), scalars)
            source = measured.select("*", *[column.alias(name) for column, name in clipped])
        inputs = [*self.tfidf_columns, *scalars]
        assembled = VectorAssembler(inputCols=inputs, outputCol=output).transform(source)
        return assembled.select(*measured.columns, output)

    def assemble(
        self, measured: DataFrame, output: str = "features", *, non_negative: bool = False
    ) -> DataFrame:
        """The vector in place of the columns it is made of."""
        parts = {*self.tfidf_columns, *self.scalar_columns}
        rest = [c for c in measured.columns if c not in parts]
        return self.add_vector(measured, output, non_negative=non_negative).select(*rest, output)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.assemble(self.measure(df))

    def save(self, path: str) -> None:
        spark = self.terms.sparkSession
        self.text_stages.write().overwrite().save(f"{path}/text_stages")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        settings = json.dumps({"orders": self.orders, "emotions": self.emotions})
        spark.createDataFrame([(settings,)], "value string").coalesce(1).write.mode(
            "overwrite"
        ).text(f"{path}/settings")

    @staticmethod
    def load(spark: SparkSession, path: str) -> FeatureModel:
        settings = json.loads(spark.read.text(f"{path}/settings").first()[0])
        stages = PipelineModel.load(f"{path}/text_stages")
        terms = spark.read.parquet(f"{path}/terms")
        counted = any(s.hasParam("outputCol") and s.getOutputCol() == TERM_COUNTS for s in stages.stages)
        weights = term_weights(terms, settings["emotions"]) if counted else None
        return FeatureModel(stages, terms, settings["orders"], settings["emotions"], weights)


def fit_features(
    train: DataFrame,
    pairs: DataFrame,
    vad: DataFrame,
    emotions: list[str],
    params: FeatureParams = FeatureParams(),
) -> FeatureModel:
    """Learn vocabularies and weights from the training texts only.

    One pass counts the terms of all n-gram orders; occurrence and document counts give both the
    vocabulary and its weights, so no further job per order is needed. Vocabularies are bounded by
    ``max_vocab`` per order and the only rows that reach the driver. An order without any term
    frequent enough has no block.
    """
    words = with_tokens(train.select("text"), output="_filtered").select("_filtered")
    learned = vocabularies(words, "_filtered", params.orders, **_limits(params)).collect()
    stages = [
        RegexTokenizer(
            inputCol="text", outputCol="_tokens", pattern=r"\w+", gaps=False, toLowercase=True
        ),
        StopWordsRemover(inputCol="_tokens", outputCol="_filtered"),
    ]
    blocks = {
        n: sorted((row for row in learned if row.n == n), key=lambda row: row["index"])
        for n in params.orders
    }
    orders = [n for n in params.orders if blocks[n]]
    for n in orders:
        stages += _block_stages(n, [r.term for r in blocks[n]], [r.idf for r in blocks[n]])
    terms = settle(term_table(pairs, vad, emotions), "lexicon")
    weights = term_weights(terms, list(emotions))
    if weights is not None:
        counter = term_counter(weights.terms, "_filtered", TERM_COUNTS)
        stages.append(counter)
    return FeatureModel(PipelineModel(stages), terms, orders, list(emotions), weights)


def _block_stages(n: int, words: list[str], weights: list[float]) -> list:
    """Counting and weighting of one n-gram order."""
    source = "_filtered" if n == 1 else f"_{n}gram"
    grams = [] if n == 1 else [NGram(n=n, inputCol="_filtered", outputCol=source)]
    counter = term_counter(words, source, f"_tf_{n}gram")
    weighting = ElementwiseProduct(
        scalingVec=Vectors.dense(weights), inputCol=f"_tf_{n}gram", outputCol=f"tfidf_{n}gram"
    )
    return [*grams, counter, weighting]


def _limits(params: FeatureParams) -> dict[str, int]:
    settings = asdict(params)
    settings.pop("ngram_orders")
    return settings


def feature_width(df: DataFrame, column: str = "features") -> int | None:
    """Vector size recorded in the column metadata, None if there is none."""
    if column not in df.columns:
        return None
    attributes = df.schema[column].metadata.get("ml_attr", {})
    width = attributes.get("num_attrs")
    return None if width is None else int(width)


def vector_names(df: DataFrame, column: str = "features") -> list[tuple[int, str]]:
    """(place, name) of every entry of an assembled vector, from the column metadata."""
    groups = df.schema[column].metadata["ml_attr"]["attrs"].values()
    return sorted((entry["idx"], entry["name"]) for group in groups for entry in group)


def vector_rows(df: DataFrame, key: str, column: str = "features") -> DataFrame:
    """(key, place, name, value) of the entries of assembled vectors that are not zero."""
    names = df.sparkSession.createDataFrame(vector_names(df, column), "place int, name string")
    parts = F.unwrap_udt(column)
    values = parts.getField("values")
    # A dense vector has no list of places.
    places = F.coalesce(parts.getField("indices"), F.sequence(F.lit(0), F.size(values) - 1))
    entries = F.arrays_zip(places.alias("place"), values.alias("value"))
    rows = df.select(key, F.inline(entries)).toDF(key, "place", "value").filter("value != 0")
    return rows.join(broadcast_if_small(names), "place").select(key, "place", "name", "value")


def feature_dims(model: FeatureModel, transformed: DataFrame) -> DataFrame:
    """(block, dims): width of every block of the assembled vector and of the whole."""
    dims = [
        (f"tfidf_{stage.getInputCol().strip('_').removeprefix('tf_')}", len(stage.getScalingVec()))
        for stage in model.text_stages.stages
        if isinstance(stage, ElementwiseProduct)
    ]
    dims += [
        ("lexicon", len(lexicon_features(model.emotions))),
        ("vad", len(vad_features())),
        ("linguistic", len(STYLE_FEATURES)),
        ("features", feature_width(transformed) or 0),
    ]
    return transformed.sparkSession.createDataFrame(dims, "block string, dims long")
