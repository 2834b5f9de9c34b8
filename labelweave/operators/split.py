"""Splits and samples that depend on the row key only, never on row order."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelweave.functions.keys import below_fraction, hex_cut, seeded_hash
from labelweave.operators.lookup import broadcast_if_small
from labelweave.scratch import settle

# Sorts after every hex digit, so 'ab' + AFTER closes the bucket of all digests starting 'ab'.
AFTER = "g"
#: Rows of a stratum that one task may rank.
MAX_RANKED = 1_000_000
#: Hex digits of a digest.
DIGEST_DIGITS = 32
#: Digits by which a prefix that holds too many rows is lengthened.
MORE_DIGITS = 3


def _keyed(df: DataFrame, key: str, stratum: str, seed: int, digits: int) -> DataFrame:
    """Only the narrow columns the ranking needs."""
    digest = seeded_hash(F.col(key), seed)
    return df.select(
        F.col(stratum).alias("_stratum"),
        F.col(key).alias("_key"),
        digest.alias("_digest"),
    ).withColumn("_bucket", F.substring("_digest", 1, digits))


def bucket_spans(keyed: DataFrame) -> DataFrame:
    """Rank range of each (stratum, digest prefix): first and last rank and the rank divisor.

    The count is partially aggregated, so the shuffle carries at most 16^digits rows per stratum
    and input partition; the running sum then sees at most 16^digits rows per stratum.
    """
    counts = keyed.groupBy("_stratum", "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    in_order = Window.partitionBy("_stratum").orderBy("_bucket")
    whole = Window.partitionBy("_stratum")
    spans = counts.select(
        "_stratum",
        "_bucket",
        (F.sum("_rows").over(in_order) - F.col("_rows")).alias("_first"),
        (F.sum("_rows").over(in_order) - 1).alias("_last"),
        F.greatest(F.sum("_rows").over(whole) - 1, F.lit(1)).alias("_divisor"),
    )
    return spans


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition


def _digits_for(keyed: DataFrame, digits: int, max_rows: int) -> int:
    """Digits at which the prefixes of the largest stratum hold ``max_rows`` rows at most, on average."""
    sizes = keyed.groupBy("_stratum").agg(F.count(F.lit(1)).alias("rows"))
    largest = sizes.agg(F.max("rows")).first()[0] or 0
    while digits < DIGEST_DIGITS and largest > max_rows * 16**digits:
        digits += 1
    return digits


def percent_ranks(
    df: DataFrame, key: str, stratum: str, *, seed: int = 42, digits: int = 3, max_rows: int = MAX_RANKED
) -> DataFrame:
    """``percent_rank()`` within each stratum in seeded-hash order, for every row.

    Equal to the plain window, but a stratum is spread over 16^digits window groups or more, so that none holds
    much over ``max_rows``: the rank inside a digest prefix plus the number of rows in smaller prefixes. A
    stratum holding a third of all rows is therefore no hot group.
    """
    keyed = _keyed(df, key, stratum, seed, digits)
    keyed = _keyed(df, key, stratum, seed, _digits_for(keyed, digits, max_rows))
    spans = broadcast_if_small(settle(bucket_spans(keyed), "spans"))
    placed = keyed.join(spans, _same(keyed, spans, ["_stratum", "_bucket"])).select(
        keyed["_stratum"], keyed["_bucket"], "_key", "_digest", "_first", "_divisor"
    )
    inside = Window.partitionBy("_stratum", "_bucket").orderBy("_digest", "_key")
    rank = F.col("_first") + F.rank().over(inside) - 1
    return placed.select(
        F.col("_key").alias(key),
        F.col("_stratum").alias(stratum),
        (rank.cast("double") / F.col("_divisor").cast("double")).alias("rank"),
    )


def _open_rows(keyed: DataFrame, edges: DataFrame, digits: int) -> DataFrame:
    """Rows of ``keyed`` in the prefixes of ``edges``, with the prefix's rank range."""
    bucketed = keyed.withColumn("_bucket", F.substring("_digest", 1, digits))
    small = broadcast_if_small(edges.select("_stratum", "_bucket", "_first", "_divisor"))
    return bucketed.join(small, _same(bucketed, small, ["_stratum", "_bucket"])).select(
        bucketed["_stratum"], bucketed["_bucket"], "_key", "_digest", "_first", "_divisor"
    )


def _finer(keyed: DataFrame, wide: DataFrame, digits: int, finer: int) -> DataFrame:
    """Spans of the longer prefixes within the prefixes of ``wide``."""
    inside = _open_rows(keyed, wide, digits)
    counts = inside.groupBy(
        "_stratum", "_bucket", "_first", "_divisor", F.substring("_digest", 1, finer).alias("_finer")
    ).agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy("_stratum", "_bucket").orderBy("_finer"))
    return counts.select(
        "_stratum",
        F.col("_finer").alias("_bucket"),
        (F.col("_first") + before - F.col("_rows")).alias("_first"),
        (F.col("_first") + before - 1).alias("_last"),
        "_divisor",
    )


def refined_spans(
    keyed: DataFrame, opens: Callable[[Column, Column], Column], digits: int, max_rows: int
) -> list[tuple[int, DataFrame, DataFrame]]:
    """(digits, closed spans, open spans) of one prefix length after the other.

    ``opens`` tells from the first and last position of a span whether a cut falls inside. Open prefixes with
    more than ``max_rows`` rows are lengthened and counted again, so that only small ones stay open.
    """
    levels = []
    spans = settle(bucket_spans(keyed), "spans")
    while True:
        at = lambda rank: F.col(rank).cast("double") / F.col("_divisor").cast("double")
        is_open = opens(at("_first"), at("_last"))
        many = F.col("_last") - F.col("_first") + 1 > max_rows
        if digits >= DIGEST_DIGITS:
            many = F.lit(False)
        levels.append((digits, spans.filter(~is_open), spans.filter(is_open & ~many)))
        wide = spans.filter(is_open & many)
        if wide.isEmpty():
            return levels
        finer = min(DIGEST_DIGITS, digits + MORE_DIGITS)
        spans = settle(_finer(keyed, wide, digits, finer), "spans")
        digits = finer


def stratified_cuts(
    df: DataFrame,
    key: str,
    stratum: str,
    ratios: tuple[float, float],
    *,
    seed: int = 42,
    digits: int = 3,
    max_rows: int = MAX_RANKED,
) -> DataFrame:
    """Per stratum, the last (digest, key) of the train part and of the validation part.

    Narrow passes over key and stratum. The first counts digest prefixes. Rank ranges settle all prefixes but
    the (at most two per stratum) in which a cut falls; these are lengthened until they hold ``max_rows`` rows
    at most, and a last pass ranks their keys. A key that many rows share is ranked once, with its count.
    """
    train_end, validation_end = ratios
    keyed = _keyed(df, key, stratum, seed, digits)

    def zone(position: Column) -> Column:
        return F.when(position <= train_end, 0).when(position <= validation_end, 1).otherwise(2)

    def at(rank: Column) -> Column:
        return rank.cast("double") / F.col("_divisor").cast("double")

    points = []
    for length, closed, opened in refined_spans(keyed, lambda a, b: zone(a) != zone(b), digits, max_rows):
        end = F.struct(
            F.concat("_bucket", F.lit(AFTER)).alias("digest"),
            F.lit(None).cast(df.schema[key].dataType).alias("key"),
        )
        points.append(closed.select("_stratum", at(F.col("_last")).alias("_position"), end.alias("_point")))
        keys = (
            _open_rows(keyed, opened, length)
            .groupBy("_stratum", "_bucket", "_digest", "_key", "_first", "_divisor")
            .agg(F.count(F.lit(1)).alias("_rows"))
        )
        inside = Window.partitionBy("_stratum", "_bucket").orderBy("_digest", "_key")
        rank = F.col("_first") + F.sum("_rows").over(inside) - F.col("_rows")
        point = F.struct(F.col("_digest").alias("digest"), F.col("_key").alias("key"))
        points.append(keys.select("_stratum", at(rank).alias("_position"), point.alias("_point")))
    cuts = (
        reduce(DataFrame.unionByName, points)
        .groupBy("_stratum")
        .agg(
            F.max(F.when(F.col("_position") <= train_end, F.col("_point"))).alias("_train"),
            F.max(F.when(F.col("_position") <= validation_end, F.col("_point"))).alias("_validation"),
        )
    )
    return settle(cuts, "cuts")


def stratified_split(
    df: DataFrame,
    key: str,
    stratum: str,
    ratios: tuple[float, float, float] = (0.70, 0.15, 0.15),
    *,
    seed: int = 42,
    digits: int = 3,
    max_rows: int = MAX_RANKED,
) -> DataFrame:
    """Add ``split``: exactly the rows a per-stratum ``percent_rank`` split would pick.

    Once the cuts are known a row is placed by comparing its own digest with two values, so the
    wide rows are neither shuffled nor sorted.
    """
    train_end = ratios[0]
    validation_end = ratios[0] + ratios[1]
    cuts = broadcast_if_small(
        stratified_cuts(df, key, stratum, (train_end, validation_end), seed=seed, digits=digits, max_rows=max_rows)
    )
    point = F.struct(seeded_hash(F.col(key), seed).alias("digest"), F.col(key).alias("key"))
    joined = df.join(cuts, F.col(stratum).eqNullSafe(F.col("_stratum")))
    split = (
        F.when(point <= F.col("_train"), F.lit("train"))
        .when(point <= F.col("_validation"), F.lit("validation"))
        .otherwise(F.lit("test"))
    )
    return joined.withColumn("split", split).select(*df.columns, "split")


def hash_split(
    df: DataFrame,
    key: str,
    ratios: tuple[float, float, float] = (0.70, 0.15, 0.15),
    *,
    seed: int = 42,
) -> DataFrame:
    """Unstratified split by keyed hash: one map pass, no shuffle."""
    digest = F.substring(seeded_hash(F.col(key), seed), 1, 8)
    split = (
        F.when(digest < hex_cut(ratios[0]), F.lit("train"))
        .when(digest < hex_cut(min(1.0, ratios[0] + ratios[1])), F.lit("validation"))
        .otherwise(F.lit("test"))
    )
    return df.withColumn("split", split)


def hash_sample(df: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """Sample without replacement that keeps the same keys on every run."""
    return df.filter(below_fraction(F.col(key), seed, fraction))


def sample_rows(df: DataFrame, key: str, rows: int, seed: int = 42) -> DataFrame:
    """``rows`` pseudo-random rows in a fixed order; a distributed top-k."""
    return df.orderBy(seeded_hash(F.col(key), seed), F.col(key)).limit(rows)


def split_counts(df: DataFrame, *extra: str) -> DataFrame:
    return df.groupBy("split", *extra).agg(F.count(F.lit(1)).alias("rows"))


def ensure_partitions(df: DataFrame, target: int | None) -> DataFrame:
    """Repartition only when a target is configured; adaptive execution sizes the rest."""
    return df.repartition(target) if target else df


def spread(df: DataFrame, key: str, partitions: int | None) -> DataFrame:
    """``df`` dealt into ``partitions`` by ``key``; unchanged without a number.

    For inputs of one or two files, which a scan cannot split. Later grouping by ``key`` reuses it.
    """
    return df.repartition(partitions, key) if partitions else df
