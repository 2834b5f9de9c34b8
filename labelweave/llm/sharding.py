"""Rendezvous sharding: each record goes to the shard whose weighted hash of its key is best.

Only the key, the shard names and their weights decide, so one more shard takes records only into itself
and no record moves between the old ones. Everything here is column expressions and joins of counts.

Defined cases: a NULL key is a key like any other and goes to one shard; rows that share a key share the
shard and get separate slots; a NULL text has size 1 and CRC 0; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelweave.scratch import settle

#: Digits of the hexadecimal digest that make up a draw; 13 digits are exact in a double.
DRAW_DIGITS = 13


def draw(key: Column, shard: int) -> Column:
    """Uniform number in (0, 1) of a key and a shard, the same on every engine and run."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f"/{shard}"))
    digits = F.substring(F.md5(text.cast("binary")), 1, DRAW_DIGITS)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**DRAW_DIGITS)


def rendezvous(key: Column, weights: Mapping[int, float] | Sequence[float]) -> Column:
    """Shard of a key: the smallest ``-ln(draw) / weight``, of equal ones the smaller shard.

    Shards with weight 0 get nothing. With equal weights this is the largest draw.
    """
    named = dict(weights) if isinstance(weights, Mapping) else dict(enumerate(weights))
    open_shards = {s: w for s, w in sorted(named.items()) if w > 0}
    if not open_shards:
        raise ValueError("no shard has a weight above 0")
    costs = [
        F.struct((-F.log(draw(key, s)) / float(w)).alias("cost"), F.lit(s).alias("shard"))
        for s, w in open_shards.items()
    ]
    return F.array_min(F.array(*costs))["shard"]


def number_rows(df: DataFrame, group: str, order: Sequence[str], slot: str, parts: int) -> DataFrame:
    """Gapless numbers from 0 within each group, in order, without sorting a group in one task.

    Rows are dealt into ``parts`` ranges of the order; a range that holds many equal rows is cut inside them.
    Numbers are the rows of the group in earlier ranges plus the place in the own range.
    """
    spread = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = spread.repartitionByRange(parts, *order, "_tie").withColumn("_range", F.spark_partition_id())
    stored = settle(ranged, "ranges")
    counts = stored.groupBy(group, "_range").count()
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col(group).alias("_group"),
        F.col("_range").alias("_r"),
        F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"),
    )
    place = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order, "_tie"))
    numbered = stored.withColumn("_place", place.cast("long") - 1)
    joined = numbered.join(starts, (F.col(group) == F.col("_group")) & (F.col("_range") == F.col("_r")))
    return joined.withColumn(slot, F.col("_start") + F.col("_place")).drop(
        "_tie", "_range", "_place", "_group", "_r", "_start"
    )


def shard_documents(
    docs: DataFrame,
    weights: Sequence[float],
    *,
    key: str = "doc_id",
    text: str = "text",
    rows_per_range: int = 200_000,
) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of each row.

    ``grown_shard`` is the shard after one more shard of the last weight has been added. Texts are read once;
    only narrow rows are stored and shuffled, into ranges of about ``rows_per_range`` rows. Slots number the
    rows of a shard by key (NULL first).
    """
    payload = F.coalesce(docs[text], F.lit(""))
    narrow = docs.select(
        docs[key].alias("doc_id"),
        (F.octet_length(payload).cast("long") + 1).alias("size"),
        F.crc32(payload.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(docs[key], weights).cast("int").alias("shard"),
        rendezvous(docs[key], [*weights, weights[-1]]).cast("int").alias("grown_shard"),
    )
    stored = settle(narrow, "shards")
    parts = max(1, -(-stored.count() // rows_per_range))
    return number_rows(stored, "shard", ["doc_id", "text_crc32", "size"], "slot", parts)
