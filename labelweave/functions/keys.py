"""Keyed hashing: the deterministic replacement for random numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def seeded_hash(key: Column, seed: int) -> Column:
    """md5 hex digest of ``seed:key``; the same row always gets the same value."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def hex_cut(fraction: float) -> str:
    """Upper bound ``x`` such that ``substr(md5, 1, 8) < x`` keeps ``fraction`` of all keys."""
    if not 0.0 <= fraction <= 1.0:
        raise ValueError("fraction must lie in [0, 1]")
    whole = round(fraction * 16**8)
    return "g" if whole >= 16**8 else f"{whole:08x}"


def below_fraction(key: Column, seed: int, fraction: float) -> Column:
    return F.substring(seeded_hash(key, seed), 1, 8) < F.lit(hex_cut(fraction))


def with_example_id(df: DataFrame, key_cols: list[str]) -> DataFrame:
    """Add ``example_id``: kept when present, a sole key column as it is, else a 128-bit digest.

    64-bit hashes collide on tables with more than a few billion rows, so the digest is md5.
    Every part is prefixed with its length, so ('ab','c') and ('a','bc') differ.
    """
    if "example_id" in df.columns:
        return df
    if not key_cols:
        raise ValueError("an example key needs at least one column")
    if len(key_cols) == 1:
        return df.withColumn("example_id", F.col(key_cols[0]))
    parts = []
    for name in key_cols:
        text = F.coalesce(F.col(name).cast("string"), F.lit(""))
        parts += [F.col(name).isNull().cast("string"), F.length(text).cast("string"), text]
    return df.withColumn("example_id", F.md5(F.concat_ws(":", *parts).cast("binary")))
