"""From rater rows to one multi-label row per example."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.taxonomy import Taxonomy

# Flag spellings that mark an example as unclear.
UNCLEAR_MARKS = ["true", "1", "yes"]


def filter_unclear(df: DataFrame, flag: str = "example_very_unclear") -> DataFrame:
    """Drop flagged rows (and rows with a NULL flag), then the flag column."""
    if flag not in df.columns:
        return df
    mark = F.lower(F.trim(F.col(flag).cast("string")))
    return df.filter(~mark.isin(UNCLEAR_MARKS)).drop(flag)


def cast_labels(df: DataFrame, labels: list[str], *, strict: bool = False) -> DataFrame:
    """Labels as doubles in one projection; bad strings become NULL unless ``strict``."""
    wanted = set(labels)

    def cast(name: str) -> Column:
        if name not in wanted:
            return F.col(name)
        value = F.col(name).cast("double") if strict else F.col(name).try_cast("double")
        return value.alias(name)

    return df.select(*[cast(name) for name in df.columns])


def collapse_raters(
    df: DataFrame, labels: list[str], key_cols: tuple[str, ...] = ("id", "text")
) -> DataFrame:
    """Maximum of every label over the raters of one example.

    Partial aggregation runs before the shuffle, so an example rated a million times still sends
    one row per input partition. The keys stay in the output.
    """
    keys = [c for c in key_cols if c in df.columns]
    if not keys:
        raise ValueError(f"none of the key columns {list(key_cols)} is present")
    return df.groupBy(*keys).agg(*[F.max(c).alias(c) for c in labels])


def coarse_label(sources: list[str]) -> Column:
    """1.0 if any source label is set; 0.0 for NULLs or when there is no source."""
    if not sources:
        return F.lit(0.0)
    cols = [F.col(c) for c in sources]
    top = cols[0] if len(cols) == 1 else F.greatest(*cols)
    return F.coalesce(top.cast("double"), F.lit(0.0))


def project_taxonomy(df: DataFrame, taxonomy: Taxonomy, keep: list[str]) -> DataFrame:
    """``keep`` columns plus one column per coarse label, in taxonomy order."""
    present = set(df.columns)
    coarse = [
        coarse_label([s for s in sources if s in present]).alias(name)
        for name, sources in taxonomy.coarse.items()
    ]
    return df.select(*[c for c in keep if c in present], *coarse)


def primary_label(labels: list[str]) -> Column:
    """Name of the first positive label, ``neutral`` if there is none."""
    picks = [F.when(F.col(c) > 0, F.lit(c)) for c in labels]
    return F.coalesce(*picks, F.lit("neutral"))


def label_array(labels: list[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in labels])


def prepare_examples(
    annotations: DataFrame,
    taxonomy: Taxonomy,
    *,
    sample_fraction: float | None = None,
    seed: int = 42,
) -> DataFrame:
    """Raw annotation rows to ``example_id, text, <coarse labels>``."""
    from labelweave.functions.keys import with_example_id
    from labelweave.operators.split import hash_sample

    cleaned = filter_unclear(annotations)
    keys = [c for c in ("id", "text") if c in cleaned.columns]
    rated = cast_labels(cleaned.select(*keys, *taxonomy.fine), taxonomy.fine)
    collapsed = collapse_raters(rated, taxonomy.fine).filter(F.col("text").isNotNull())
    coarse = project_taxonomy(with_example_id(collapsed, keys), taxonomy, ["example_id", "text"])
    if sample_fraction is not None and 0 < sample_fraction < 1:
        coarse = hash_sample(coarse, "example_id", sample_fraction, seed)
    return coarse.withColumn("text", F.col("text").cast("string"))
