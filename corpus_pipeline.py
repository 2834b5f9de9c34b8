"""A corpus pipeline: reject toxic documents, remove exact and near copies, mix sources, pack sequences.

Each stage takes the rows that the one before kept, as they were written, and its decisions take effect: rows
that it rejects are gone, rows that the mix takes twice occur twice. All but the last return the columns of
``documents``; the last returns a row for each piece of each document with its place in a sequence.

Defined cases: a NULL or empty text is scored by the chain's intercepts alone; texts that are NULL or hold
nothing but white space are equal to others of their kind, so the first of each kind stays; without words they
are nobody's near copy, weigh nothing in the mix and are packed as a row without a bin. Equal rows are exact
copies; a NULL source is a source of its own; extra columns stay up to the last stage; an empty table gives one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from labelweave.llm import exact, mixing, ordermin, packing, toxicity
from labelweave.llm.queries import CATEGORIES, SOURCE_WEIGHTS, category_labels, table
from labelweave.scratch import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Texts that Spark hands to Python at a time; the default of 10,000 holds tens of MB twice in each task.
TEXTS_AT_A_TIME = 1_000


def small_batches(spark: SparkSession) -> None:
    """Stages that read whole texts in Python run with small batches, also after they have returned."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXTS_AT_A_TIME))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    chain = toxicity.fit_chain(category_labels(docs, table(spark, sf_dir, "labels")), CATEGORIES)
    return toxicity.keep_clean(docs, chain)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return ordermin.keep_one_of_each(docs)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, SOURCE_WEIGHTS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("source_mix", mix_to_targets),
    ("packing", pack_sequences),
]

#: The classifier, the alignment, the balanced sample and the packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            path = scratch_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
