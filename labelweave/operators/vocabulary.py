"""N-gram vocabularies, inverse document frequencies and the long TF-IDF table."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelweave.functions.text import word_ngrams
from labelweave.operators.lookup import broadcast_if_small, is_small
from labelweave.scratch import python_rows, settle

#: Counters of an order: what each task keeps, whatever the number of different terms.
BUCKETS = 1 << 22
#: Counters that a task hands over as one value, so that few rows are shuffled.
BLOCK = 1 << 14
#: Tokens that a task handles at a time; a longer document is taken alone.
CHUNK_TOKENS = 1 << 20
#: Documents that Spark hands to Python at a time.
CHUNK_ROWS = 1_000
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: What may stand between terms that are handed over as one string; none has a meaning in a pattern.
_MARKS = ("\n", "\x00", "\x1f")

def term_statistics(df: DataFrame, tokens: str, orders: list[int]) -> DataFrame:
    """(n, term, occurrences, documents) for all n-gram orders in one pass.

    Each document contributes its n-grams once with and once without repeats, so document
    frequencies need no distinct (document, term) shuffle: partial sums leave one row per term and
    input partition, however often a term occurs.
    """
    bags = []
    for n in orders:
        grams = word_ngrams(F.col(tokens), n)
        bags.append(F.struct(F.lit(n).alias("n"), F.lit(True).alias("every"), grams.alias("terms")))
        bags.append(
            F.struct(
                F.lit(n).alias("n"), F.lit(False).alias("every"), F.array_distinct(grams).alias("terms")
            )
        )
    # Top-level columns, so that exploding a bag does not carry the bag along with each term.
    rows = (
        df.select(F.inline(F.array(*bags)))
        .select("n", "every", F.explode_outer("terms").alias("term"))
        .filter(F.col("term").isNotNull())
    )
    every = F.col("every")
    return rows.groupBy("n", "term").agg(
        F.sum(F.when(every, 1).otherwise(0)).alias("occurrences"),
        F.sum(F.when(every, 0).otherwise(1)).alias("documents"),
    )


def candidate_statistics(df: DataFrame, tokens: str, n: int, frequent: DataFrame) -> DataFrame:
    """``term_statistics`` of the n-grams whose two (n-1)-grams are both in ``frequent`` (term), a small table.

    An n-gram cannot be in more documents than a part of it, so all that are frequent are among them; the many
    others are left out in the map tasks, before anything is shuffled. Tokens must not hold blanks.
    """
    grams = word_ngrams(F.col(tokens), n)
    bags = [
        F.struct(F.lit(every).alias("every"), bag.alias("terms"))
        for every, bag in ((True, grams), (False, F.array_distinct(grams)))
    ]
    rows = df.select(F.inline(F.array(*bags))).select("every", F.explode("terms").alias("term"))
    parts = rows.select(
        "*",
        F.substring_index("term", " ", n - 1).alias("_head"),
        F.substring_index("term", " ", 1 - n).alias("_tail"),
    )
    for part in ("_head", "_tail"):
        parts = parts.join(F.broadcast(frequent.select(F.col("term").alias(part))), part, "left_semi")
    every = F.col("every")
    return parts.groupBy(F.lit(n).alias("n"), "term").agg(
        F.sum(F.when(every, 1).otherwise(0)).alias("occurrences"),
        F.sum(F.when(every, 0).otherwise(1)).alias("documents"),
    )


def frequent_terms(df: DataFrame, tokens: str, orders: list[int], min_df: int, **bounds: int) -> DataFrame:
    """Stored (n, term, occurrences, documents) of the n-grams that ``min_df`` documents have.

    One pass for each order, the shorter n-grams first: they tell which longer ones can be frequent at all (the
    two orders below a wanted one are counted for that alone). Where they are too many to be broadcast, all
    longer ones are counted.
    """
    kept, below = [], None
    for n in range(1, max(orders) + 1):
        if n not in orders and n + 1 not in orders and n + 2 not in orders:
            below = None
            continue
        counted = term_statistics(df, tokens, [n]) if below is None else candidate_statistics(df, tokens, n, below)
        frequent = settle(counted.filter(F.col("documents") >= min_df), f"terms_{n}")
        if n in orders:
            kept.append(frequent)
        terms = frequent.select("term")
        below = terms if n < max(orders) and is_small(terms, **bounds) else None
    return reduce(lambda left, right: left.unionByName(right), kept)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with about ``CHUNK_TOKENS`` tokens, the hashes of their tokens and the row of each.

    The first column holds lists of token hashes.
    """
    for batch in batches:
        sizes = pc.list_value_length(batch.column(0)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, row = np.cumsum(sizes), 0
        while row < len(sizes):
            limit = ends[row] - sizes[row] + CHUNK_TOKENS
            end = max(row + 1, int(np.searchsorted(ends, limit, side="right")))
            part = batch.slice(row, end - row)
            hashes = part.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            yield part, hashes, np.repeat(np.arange(end - row), sizes[row:end])
            row = end


def _grams(hashes: np.ndarray, row: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First token and bucket of each n-gram of the rows; ``size`` buckets, a power of two."""
    count = max(0, len(hashes) - n + 1)
    mixed = hashes[:count]
    for k in range(1, n):
        mixed = mixed * _SPREAD + hashes[k : k + count]
    buckets = ((mixed ^ (mixed >> np.uint64(32))) * _SPREAD) >> np.uint64(64 - (size - 1).bit_length())
    at = np.flatnonzero(row[:count] == row[n - 1 : n - 1 + count])
    return at, buckets[at].astype(np.int64)


def _bucket_batches(orders: list[int], size: int):
    """(n, block, counters) of all n-grams of a partition: occurrences by bucket, ``BLOCK`` buckets to a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {n: np.zeros(size, np.int64) for n in orders}
        for _, hashes, row in _chunks(batches):
            for n in orders:
                buckets, counts = np.unique(_grams(hashes, row, n, size)[1], return_counts=True)
                sums[n][buckets] += counts
        for n, counts in sums.items():
            for block, part in enumerate(np.split(counts, range(BLOCK, size, BLOCK))):
                if part.any():
                    packed = part.astype(np.min_scalar_type(part.max())).tobytes()  # as few bytes as the counts need
                    columns = [pa.array([n], pa.int32()), pa.array([block], pa.int32()), pa.array([packed])]
                    yield pa.RecordBatch.from_arrays(columns, ["n", "block", "counters"])

    return run


def _add_blocks(length: int):
    """(n, bucket, occurrences) of the counters of one block of ``length``, added up over all partitions."""

    def run(key: tuple, blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, block = (k.as_py() for k in key)
        sums = np.zeros(length, np.int64)
        for batch in blocks:
            for value in batch.column("counters"):
                packed = value.as_buffer()
                sums += np.frombuffer(packed, f"u{len(packed) // length}").astype(np.int64)
        used = np.flatnonzero(sums)
        columns = [np.full(len(used), n, np.int32), (used + block * BLOCK).astype(np.int32), sums[used]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["n", "bucket", "occurrences"])

    return run


def _term_batches(open_buckets: dict[int, np.ndarray]):
    """(n, term, occurrences, documents) of the n-grams whose bucket is marked, a row for each term and run of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = {n: np.unpackbits(bits).astype(bool) for n, bits in open_buckets.items()}
        for part, hashes, row in _chunks(batches):
            tokens = part.column(1).flatten()
            for n, marked in marks.items():
                at, buckets = _grams(hashes, row, n, len(marked))
                at = at[marked[buckets]]
                words = [tokens.take(pa.array(at + k)) for k in range(n)]
                grams = pc.binary_join_element_wise(*words, " ") if n > 1 else words[0]
                given = grams.is_valid()  # an n-gram with a missing token is none
                coded, at = grams.filter(given).dictionary_encode(), at[given.to_numpy(zero_copy_only=False)]
                size, codes = len(coded.dictionary), coded.indices.to_numpy().astype(np.int64)
                once = np.unique(row[at] * max(size, 1) + codes) % max(size, 1)
                counts = [pa.array(np.bincount(c, minlength=size).astype(np.int64)) for c in (codes, once)]
                columns = [pa.array(np.full(size, n, np.int32)), coded.dictionary, *counts]
                yield pa.RecordBatch.from_arrays(columns, ["n", "term", "occurrences", "documents"])

    return run


def leading_terms(
    df: DataFrame, tokens: str, orders: list[int], min_df: int, max_vocab: int, buckets: int = BUCKETS
) -> DataFrame:
    """Stored (n, term, occurrences, documents): of the n-grams that ``min_df`` documents have, the ``max_vocab``
    most frequent of each order and their ties, with some others.

    A first pass counts hash buckets, so memory and shuffle do not follow the number of different n-grams. A
    bucket's count is no less than that of any n-gram in it; the second pass counts the n-grams of the
    fullest buckets as they are written. If fewer than ``max_vocab`` of them reach the count below which buckets
    were left out, the pass is run again for that order with a lower one, down to the count that ``min_df`` implies.
    """
    spark = df.sparkSession
    rows = df.select(F.col(tokens).alias("tokens"))
    hashed = rows.select(F.transform("tokens", lambda t: F.xxhash64(t)).alias("hashes"), "tokens")
    with python_rows(spark, CHUNK_ROWS):
        parts = hashed.select("hashes").mapInArrow(_bucket_batches(orders, buckets), "n int, block int, counters binary")
        added = parts.groupBy("n", "block").applyInArrow(
            _add_blocks(min(buckets, BLOCK)), "n int, bucket int, occurrences long"
        )
        filled = settle(added, "buckets")
    least = max(1, min_df)
    cuts, kept = {n: max(least, cut) for n, cut in first_cuts(filled, orders, max_vocab).items()}, []
    while cuts:
        marks = {}
        for n, cut in cuts.items():
            chosen = filled.filter((F.col("n") == n) & (F.col("occurrences") >= cut)).select("bucket").toArrow()
            marked = np.zeros(buckets, bool)
            marked[chosen["bucket"].to_numpy()] = True
            marks[n] = np.packbits(marked)
        with python_rows(spark, CHUNK_ROWS):
            parts = hashed.mapInArrow(_term_batches(marks), "n int, term string, occurrences long, documents long")
            counted = parts.groupBy("n", "term").agg(
                F.sum("occurrences").alias("occurrences"), F.sum("documents").alias("documents")
            )
            found = settle(counted.filter(F.col("documents") >= min_df), "terms")
        reached = reduce(lambda a, b: a | b, [(F.col("n") == n) & (F.col("occurrences") >= cut) for n, cut in cuts.items()])
        enough = {r["n"] for r in found.filter(reached).groupBy("n").count().collect() if r["count"] >= max_vocab}
        done = [n for n, cut in cuts.items() if cut == least or n in enough]
        kept.append(found.filter(F.col("n").isin(done)))
        cuts = {n: max(least, cut // 4) for n, cut in cuts.items() if n not in done}
    return reduce(DataFrame.unionByName, kept)


def occurrence_cuts(counted: DataFrame, max_vocab: int) -> dict[int, int]:
    """Per order, an occurrence count that at least ``max_vocab`` terms reach (0 if fewer exist).

    Works on the distinct counts, of which there are few, and returns one number per order.
    """
    levels = counted.groupBy("n", "occurrences").agg(F.count(F.lit(1)).alias("terms"))
    reached = F.sum("terms").over(Window.partitionBy("n").orderBy(F.desc("occurrences")))
    full = levels.withColumn("reached", reached).filter(F.col("reached") >= max_vocab)
    rows = full.groupBy("n").agg(F.max("occurrences").alias("cut")).collect()
    return {row.n: row.cut for row in rows}


def first_cuts(filled: DataFrame, orders: list[int], max_vocab: int) -> dict[int, int]:
    """Per order, a count that ``max_vocab`` n-grams will most likely reach, from the counts of their buckets.

    Rare n-grams that share a bucket add to its count, about as much as the median bucket holds.
    """
    full = occurrence_cuts(filled, max_vocab)
    rows = filled.groupBy("n").agg(F.percentile_approx("occurrences", 0.5, 1_000).alias("shared")).collect()
    shared = {row.n: row.shared for row in rows}
    return {n: max(0, full.get(n, 0) - shared.get(n, 0)) * 2 // 3 for n in orders}


def top_terms(counted: DataFrame, n: int, max_vocab: int, cut: int = 0) -> DataFrame:
    """The ``max_vocab`` most frequent terms of one order, ties by term, numbered from 0.

    ``cut`` lets the scan skip terms that cannot be among them, so the top-k that follows sorts
    little more than its result; only that bounded result is numbered.
    """
    kept = (
        counted.filter((F.col("n") == n) & (F.col("occurrences") >= cut))
        .orderBy(F.desc("occurrences"), F.asc("term"))
        .limit(max_vocab)
    )
    place = Window.partitionBy("n").orderBy(F.desc("occurrences"), F.asc("term"))
    return kept.select(
        "n", "term", "occurrences", "documents", (F.row_number().over(place) - 1).alias("index")
    )


def idf_weight(documents: Column, total: Column, min_doc_freq: int) -> Column:
    """Smoothed inverse document frequency, 0 below the minimum document frequency."""
    smoothed = F.ln((total + 1).cast("double") / (documents + 1).cast("double"))
    return F.when(documents >= min_doc_freq, smoothed).otherwise(F.lit(0.0))


def vocabularies(
    df: DataFrame,
    tokens: str,
    orders: list[int],
    *,
    max_vocab: int = 20_000,
    min_df: int = 5,
    idf_min_doc_freq: int = 1,
) -> DataFrame:
    """(n, term, occurrences, documents, index, idf) of every order.

    Terms below ``min_df``, and most of those that are too rare for the top-k, are gone before the counts are stored.
    """
    counted = leading_terms(df, tokens, sorted(set(orders)), min_df, max_vocab)
    cuts = occurrence_cuts(counted, max_vocab)
    tops = reduce(
        lambda left, right: left.unionByName(right),
        [top_terms(counted, n, max_vocab, cuts.get(n, 0)) for n in orders],
    )
    total = F.lit(df.count())
    return tops.withColumn("idf", idf_weight(F.col("documents"), total, idf_min_doc_freq))


def term_counter(terms: list[str], source: str, output: str) -> CountVectorizerModel:
    """``CountVectorizerModel.from_vocabulary``; the terms go to the JVM as one string and not one by one.

    A call for each of 60,000 terms takes longer than to count them over 0.1 GB of texts.
    """
    mark = next((m for m in _MARKS if not any(m in term for term in terms)), None)
    if not terms or mark is None:
        return CountVectorizerModel.from_vocabulary(terms, inputCol=source, outputCol=output)
    sc = SparkSession.active().sparkContext
    array = sc._jvm.java.util.regex.Pattern.compile(mark).split(mark.join(terms), -1)
    model = CountVectorizerModel._create_from_java_class("org.apache.spark.ml.feature.CountVectorizerModel", array)
    model.setInputCol(source).setOutputCol(output)
    return model._set(vocabSize=len(terms))


def sparse_entries(vector: Column) -> Column:
    """Non-zero entries of a sparse vector as an array of (index, value)."""
    parts = F.unwrap_udt(vector)
    return F.arrays_zip(
        parts.getField("indices").alias("index"), parts.getField("values").alias("value")
    )


def tfidf_rows(df: DataFrame, key: str, tokens: str, vocabulary: DataFrame, n: int) -> DataFrame:
    """(key, term, tf, tfidf) of one order.

    The counts of a document come from its own row, so nothing is grouped or shuffled; the
    vocabulary is bounded by its configured size.
    """
    kept = vocabulary.filter(F.col("n") == n).select("index", "term", "idf")
    words = [row.term for row in kept.orderBy("index").collect()]
    if not words:
        return df.select(key, F.lit("").alias("term"), F.lit(0.0).alias("tf"), F.lit(0.0).alias("tfidf")).limit(0)
    counter = term_counter(words, "_grams", "_tf")
    grams = df.select(key, F.coalesce(word_ngrams(F.col(tokens), n), F.array().cast("array<string>")).alias("_grams"))
    entries = counter.transform(grams).select(key, F.inline(sparse_entries(F.col("_tf"))))
    entries = entries.toDF(key, "index", "tf")
    return entries.join(broadcast_if_small(kept), "index").select(
        key, "term", "tf", (F.col("tf") * F.col("idf")).alias("tfidf")
    )
