"""The operators over the given tables, as registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm import (
    exact,
    mixing,
    ordermin,
    packing,
    repeats,
    resample,
    rules,
    secret_scan,
    sharding,
    tokens,
    toxicity,
    urls,
    whitening,
)
from labelweave.scratch import scratch_path, settle

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(run: Query) -> Query:
    REGISTRY[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The rules of the URL contract.
URL_RULES = urls.UrlRules(block=("net/", "example.com/de/"), allow=("example.net/en/", "org/fr/"))
# Words that mark a listed domain.
LISTED_WORDS = ("adult", "bets", "casino", "spam")


def listed_domains(pages: DataFrame) -> DataFrame:
    """Block list of the query: hosts whose name has one of the words, without a leading www, m or blog."""
    host = F.regexp_replace(urls.host_of(F.col("url")), r"^(www|m|blog)\.", "")
    hosts = pages.select(host.alias("key")).distinct()
    return hosts.filter(F.col("key").rlike("|".join(LISTED_WORDS)))


@query
def op1_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secret_scan.BlobLedger(scratch_path(spark, "ledger"))
    return secret_scan.scan_documents(docs, ledger).drop("blob")


@query
def op2_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op3_quotient_filter_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact.exact_duplicates(docs).drop("_row")


@query
def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ordermin.near_duplicates(docs).drop("_row")


@query
def op5_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = settle(rules.document_counts(table(spark, sf_dir, "documents")), "counts")
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    # The list decides about what the base keeps, so it is learned from such documents.
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = counts.filter(~base_failed).join(marks, "doc_id")
    features = rules.feature_columns()
    learned = rules.learn_decision_list(labelled, features, F.col("quality") == 0)
    reason = learned.reason(features)
    return counts.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & reason.isNull()).alias("kept"),
        F.when(base_failed, "base").otherwise(reason).alias("reason"),
    )


# Weights of the sources, in order of their names.
SOURCE_WEIGHTS = (5.0, 2.0, 1.0)


@query
def op6_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mix = mixing.mix_sources(docs, SOURCE_WEIGHTS)
    return mix.select("doc_id", "size", "source_size", "target", "taken")


# The categories that the labels have: low quality first, toxicity last.
CATEGORIES = ("low_quality", "toxic")


def category_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts with their 0/1 categories; of several labels of a document the worse one counts."""
    marks = labels.groupBy("doc_id").agg(
        (1 - F.min("quality")).alias("low_quality"), F.max("toxic").alias("toxic")
    )
    return docs.select("doc_id", "text").join(marks, "doc_id")


@query
def op7_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.fit_chain(category_labels(docs, table(spark, sf_dir, "labels")), CATEGORIES)
    return toxicity.score_documents(docs, chain)


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op9_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = urls.judge_urls(pages, URL_RULES, listed_domains(pages))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query
def op10_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard_documents(docs, [1.0] * 8)


@query
def op11_qdwh_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


# Tokens that a document may have.
TOKEN_LIMIT = 512


@query
def op12_two_tier_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokens.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query
def op13_bracketed_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample.resample(docs, table(spark, sf_dir, "benchmark"), percent=10, least_words=20, seed=2024)
