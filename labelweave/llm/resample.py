"""Importance resampling towards a target corpus, with the cutoff found by bracketing.

A row's features are the runs of up to ``runs`` consecutive words, each put into one of ``buckets`` by its
CRC-32. Bucket counts of the rows and of the target give every bucket a gain; an array of gains scores all
features of a row at once, and their floored mean is the row's weight. Gumbel noise from a hash of the key
turns the highest scores into a weighted sample without replacement.

The rows drawn are those above a cutoff. A quantile sketch of the scores brackets it; exact counts above and
inside the bracket show whether the cutoff lies inside, and a bracket that misses is widened. Only rows of the
bracket are sorted to find the cutoff, and only rows drawn are sorted to be ranked, both by ranges whose
sizes do not follow equal scores or keys.

Defined cases: a NULL or empty text has no words, no features and weight 0; a NULL key hashes as an empty one
and comes after all others in ties; equal rows are separate rows, drawn one by one; an empty target or table
has counts of 0; extra columns are dropped, whatever their names; one text may have any length.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.llm.rows import ranked, release
from labelweave.llm.words import Texts, Words, find_words, text_chunks, window_starts
from labelweave.scratch import settle

#: Size of the quantile sketch, and the share of rows on either side of the guess that the bracket takes.
SKETCH_SIZE = 2048
HALF_WIDTH = 0.005
#: Groups in which sketches are made before they are merged.
SKETCH_GROUPS = 64
#: Bytes of a word that are hashed for all words of a chunk at once; longer words are hashed one by one.
LOCKSTEP_BYTES = 64


def _crc_table() -> np.ndarray:
    """Table of the reflected CRC-32 polynomial."""
    values = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        values = np.where(values & 1, (values >> 1) ^ np.uint32(0xEDB88320), values >> 1)
    return values


_CRC = _crc_table()
_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[0x30:0x3A] = _WORD_BYTE[0x61:0x7B] = _WORD_BYTE[0x80:] = True


def lowered(texts: Texts) -> Texts:
    """A to Z in lower case, all else unchanged."""
    data = texts.data.copy()
    data[(data >= 0x41) & (data <= 0x5A)] += 32
    return Texts(data, texts.offsets, texts.first)


def crc_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """CRC-32 of each span, continued from the checksums ``before``."""
    crc = np.zeros(len(starts), np.uint32) if before is None else before.copy()
    sizes = ends - starts
    long = np.flatnonzero(sizes > LOCKSTEP_BYTES)
    for i in long:
        crc[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(crc[i]))
    order = np.argsort(-np.where(sizes > LOCKSTEP_BYTES, 0, sizes), kind="stable")
    state, first, left = ~crc[order], starts[order], np.where(sizes > LOCKSTEP_BYTES, 0, sizes)[order]
    for step in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -step))  # spans longer than ``step`` stand in front
        byte = data[first[:n] + step]
        state[:n] = _CRC[(state[:n] ^ byte) & 0xFF] ^ (state[:n] >> 8)
    crc[order] = ~state
    return crc


@dataclass(frozen=True)
class FeatureSpace:
    runs: int = 1
    buckets: int = 10_000

    def of(self, texts: Texts) -> tuple[Words, list[tuple[np.ndarray, np.ndarray]]]:
        """The words, and for each run length the text and the bucket of each run."""
        texts = lowered(texts)
        words = find_words(texts, _WORD_BYTE[texts.data])
        crc = crc_of(texts.data, words.starts, words.ends)
        found = [(words.doc, crc % self.buckets)]
        for size in range(2, self.runs + 1):
            at = window_starts(words, size)
            # Longer runs continue the checksums of those one word shorter that start at the same word.
            grown = np.zeros(len(crc), np.uint32)
            spaced = ~(_CRC[(~crc[at] ^ 0x20) & 0xFF] ^ (~crc[at] >> 8))
            last = at + size - 1
            grown[at] = crc_of(texts.data, words.starts[last], words.ends[last], spaced)
            crc = grown
            found.append((words.doc[at], crc[at] % self.buckets))
        return words, found


def _count_batches(space: FeatureSpace):
    """Features of a task's rows in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(space.buckets, dtype=np.int64)
        for batch in batches:
            for texts in text_chunks(batch.column(batch.num_columns - 1)):
                for _, buckets in space.of(texts)[1]:
                    counts += np.bincount(buckets, minlength=space.buckets)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(counts[met])], ["bucket", "n"])
        release()

    return run


def bucket_counts(texts: DataFrame, space: FeatureSpace, *, text: str = "text") -> np.ndarray:
    """Features of all rows in each bucket; tasks send at most a row for each bucket."""
    parts = texts.select(text).mapInArrow(_count_batches(space), "bucket int, n long")
    counts = np.zeros(space.buckets, dtype=np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def bucket_gains(rows: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down."""
    size = float(len(rows))
    all_rows, all_target = float(rows.sum()), float(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log((float(t) + 1) * (all_rows + size) / ((float(s) + 1) * (all_target + size))))
            for s, t in zip(rows, target)
        ],
        dtype=np.int64,
    )


def _weight_batches(space: FeatureSpace, gains: np.ndarray):
    """All columns but the text, then words, features and the floored mean gain of the features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in text_chunks(batch.column(batch.num_columns - 1)):
                words, runs = space.of(texts)
                features, total = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
                for doc, buckets in runs:
                    edges = np.searchsorted(doc, np.arange(len(texts) + 1))
                    sums = np.concatenate([[0], np.cumsum(gains[buckets])])
                    features += np.diff(edges)
                    total += sums[edges[1:]] - sums[edges[:-1]]
                weight = np.where(features > 0, total // np.maximum(features, 1), 0)
                rest = [c.slice(texts.first, len(texts)) for c in batch.columns[:-1]]
                own = [pa.array(words.counts().astype(np.int64)), pa.array(features), pa.array(weight)]
                yield pa.RecordBatch.from_arrays([*rest, *own], ["key", "n_words", "n_features", "weight"])
        release()

    return run


def gumbel(key: Column, seed: int) -> Column:
    """Thousandths of Gumbel noise, rounded down, from the hash of the key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def bracket(scores: DataFrame, drawn: int, total: int) -> tuple[int, int, int]:
    """Least and greatest score of a bracket that holds the ``drawn``-th highest score, and the rows above it."""
    sketches = scores.groupBy(F.pmod("row", F.lit(SKETCH_GROUPS))).agg(
        F.kll_sketch_agg_bigint("score", F.lit(SKETCH_SIZE)).alias("sketch")
    )
    merged = settle(sketches.agg(F.kll_merge_agg_bigint("sketch").alias("sketch")), "sketch")
    half = HALF_WIDTH
    while True:
        at = 1 - drawn / total
        low, high = max(0.0, at - half), min(1.0, at + half)
        guess = merged.select(
            F.kll_sketch_get_quantile_bigint("sketch", F.lit(low)).alias("low"),
            F.kll_sketch_get_quantile_bigint("sketch", F.lit(high)).alias("high"),
        ).first()
        bottom = -(1 << 62) if low == 0 else guess["low"]
        top = 1 << 62 if high == 1 else guess["high"]
        above, inside = scores.agg(
            F.count_if(F.col("score") > top), F.count_if(F.col("score").between(bottom, top))
        ).first()
        if above < drawn <= above + inside:
            return bottom, top, above
        half *= 4


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    percent: int,
    least_words: int,
    seed: int,
    space: FeatureSpace = FeatureSpace(),
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """(key, n_features, weight, score, rank) of every row; ``rank`` counts the rows drawn from 1, else NULL.

    Of the rows with ``least_words`` words, ``percent`` of a hundred are drawn, rounded down. Buckets and gains
    reach the driver; rows do not.
    """
    gains = bucket_gains(bucket_counts(docs, space, text=text), bucket_counts(target, space, text=target_text))
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    weighed = rows.mapInArrow(_weight_batches(space, gains), f"key {kind}, n_words long, n_features long, weight long")
    scored = settle(
        weighed.select(
            "*",
            (F.col("weight") + gumbel(F.col("key"), seed)).alias("score"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "scored",
    )
    ready = scored.filter(F.col("n_words") >= least_words)
    total = ready.count()
    count = percent * total // 100
    out = [F.col("key").alias(key), "n_features", "weight", "score"]
    nothing = F.lit(None).cast("long").alias("rank")
    if not count:
        return scored.select(*out, nothing)
    # Equal scores by key, NULL last; rows equal in both by their number.
    order = [F.desc("score"), F.col("key").isNull(), F.col("key"), F.col("row")]
    bottom, top, above = bracket(ready, count, total)
    inside = ranked(ready.filter(F.col("score").between(bottom, top)).select("score", "key", "row"), order, "place")
    cut = inside.filter(F.col("place") == count - above).first()
    place = F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("key"), F.col("row").alias("row"))
    edge = F.struct(
        F.lit(cut["key"] is None).alias("none"), F.lit(cut["key"]).cast(kind).alias("key"), F.lit(cut["row"]).alias("row")
    )
    before = (F.col("score") > cut["score"]) | ((F.col("score") == cut["score"]) & (place <= edge))
    taken = (F.col("n_words") >= least_words) & before
    numbered = ranked(scored.filter(taken), order, "rank")
    return numbered.select(*out, "rank").unionByName(scored.filter(~taken).select(*out, nothing))
