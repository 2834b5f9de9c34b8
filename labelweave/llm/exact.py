"""Exact duplicates by counting quotient filters.

Each partition builds a filter of its fingerprints: the high bits of a fingerprint are its quotient, the
filter keeps the low bits (remainders) of each quotient in sorted order with a count. Filters of one quotient
range merge losslessly by merging their sorted remainders and adding counts. Fingerprints with a count above
one go to byte verification; all others are known to be unique, so their texts are never shuffled.

A row's class is decided by the bytes of its normalised text. Defined cases: a NULL text counts as empty;
empty texts are equal to each other; of equal texts the smallest id stays, NULL ids last; of repeated rows
with that id exactly one stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.llm.rows import bounded, fresh, numbered, without
from labelweave.scratch import settle

#: Bits of the fingerprint that name the quotient range, bits that are the quotient inside it.
RANGE_BITS, QUOTIENT_BITS = 10, 16

_FILTER = "range int, runs binary, remainders binary, counts binary"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def encode_filter(fingerprints: np.ndarray, counts: np.ndarray) -> dict[int, tuple[bytes, bytes, bytes]]:
    """Counting quotient filters by range, from sorted distinct fingerprints.

    ``runs`` has the number of remainders of each quotient that occurs (quotient, length), in order.
    """
    low = np.uint64(64 - RANGE_BITS - QUOTIENT_BITS)
    heads = fingerprints >> low
    remainders = fingerprints & ((np.uint64(1) << low) - np.uint64(1))
    ranges = (heads >> np.uint64(QUOTIENT_BITS)).astype(np.int64)
    out = {}
    bounds = np.flatnonzero(np.diff(ranges, prepend=-1, append=-1))
    for a, b in zip(bounds[:-1], bounds[1:]):
        quotients, lengths = np.unique(heads[a:b] & np.uint64((1 << QUOTIENT_BITS) - 1), return_counts=True)
        runs = np.stack([quotients.astype(np.uint32), lengths.astype(np.uint32)])
        out[int(ranges[a])] = (
            runs.tobytes(), remainders[a:b].tobytes(), counts[a:b].astype(np.uint32).tobytes(),
        )
    return out


def decode_filter(at: int, runs: bytes, remainders: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted fingerprints of one range and their counts."""
    low = np.uint64(64 - RANGE_BITS - QUOTIENT_BITS)
    quotients, lengths = np.frombuffer(runs, np.uint32).reshape(2, -1)
    heads = np.repeat(quotients.astype(np.uint64), lengths) | np.uint64(at << QUOTIENT_BITS)
    return (heads << low) | np.frombuffer(remainders, np.uint64), np.frombuffer(counts, np.uint32)


def merge_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Merge sorted runs; counts of equal fingerprints add up."""
    keys = np.concatenate([k for k, _ in parts])
    order = np.argsort(keys, kind="stable")  # merges presorted runs
    keys = keys[order]
    starts = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    counts = np.concatenate([c for _, c in parts]).astype(np.int64)[order]
    return keys[starts], np.add.reduceat(counts, starts)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A filter for each range, of about a million rows at a time."""
    pending: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        keys, counts = merge_counts(pending)
        found = encode_filter(keys, counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found.keys(), pa.int32()), *(pa.array([x[i] for x in found.values()], pa.binary()) for i in range(3))],
            ["range", "runs", "remainders", "counts"],
        )

    for batch in batches:
        if batch.num_rows:
            keys, counts = np.unique(batch.column(0).to_numpy().view(np.uint64), return_counts=True)
            pending.append((keys, counts))
        if sum(len(k) for k, _ in pending) > 1_000_000:
            yield from flush()
            pending = []
    if pending:
        yield from flush()


def _merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the filters of a range as they come and emit the repeated fingerprints."""
    merged = None
    for batch in batches:
        parts = [decode_filter(*row.values()) for row in batch.to_pylist()]
        if parts:
            merged = merge_counts([*([merged] if merged else []), *parts])
    keys, counts = merged
    again = counts > 1
    yield pa.RecordBatch.from_arrays([pa.array(keys[again].view(np.int64))], ["fp"])


def repeated_fingerprints(rows: DataFrame) -> DataFrame:
    """Fingerprints (column ``fp`` of 64 bits) that occur more than once.

    A range holds one entry for each distinct fingerprint and filter, so copies in hot groups cost one entry
    for each partition, not one for each row. ``RANGE_BITS`` sets the number of ranges: 1,024 of them keep a
    range of ten billion fingerprints at 120 MB.
    """
    filters = rows.select("fp").mapInArrow(_build, _FILTER)
    return filters.groupBy("range").applyInArrow(_merge, "fp bigint")


def exact_duplicates(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", row: str | None = None
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, _row) for each row.

    Texts are normalised (runs of white space become one space) and read twice: once for fingerprints and
    digests, once for the bytes of rows whose fingerprint is repeated. ``row`` names a column that numbers
    the rows; without it they are numbered as they are read.
    """
    norm = normalised(docs[text])
    narrow = settle(
        docs.select(
            docs[key].alias("doc_id"),
            F.xxhash64(norm).alias("fp"),
            F.sha2(norm, 256).alias("text_sha256"),
            (docs[row] if row else F.monotonically_increasing_id()).alias("_row"),
        ),
        "fingerprints",
    )
    repeated = bounded(settle(repeated_fingerprints(narrow), "repeated"))
    # Groups of digests, and the groups that the bytes themselves make; both combine before they shuffle.
    groups = (
        narrow.join(repeated, "fp", "left_semi")
        .groupBy("fp", "text_sha256")
        .agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row")).alias("_first"),
            F.count("*").alias("group_size"),
        )
    )
    verified = (
        docs.select(norm.alias("_norm"), F.xxhash64(norm).alias("fp"))
        .join(repeated, "fp", "left_semi")
        .groupBy("fp", "_norm")
        .count()
        .filter("count > 1")
        .select("fp", F.sha2("_norm", 256).alias("text_sha256"), F.col("count").alias("group_size"))
    )
    classes = settle(groups.join(verified, ["fp", "text_sha256", "group_size"]), "classes")
    found = narrow.join(classes, ["fp", "text_sha256"], "left")
    alone = F.col("_first").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("_first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("_first._row") == F.col("_row"))).alias("kept"),
        "text_sha256",
        "_row",
    )


def keep_first(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text an earlier id has; all columns stay."""
    row = fresh(docs, "_row")
    stored = numbered(docs, row)
    found = exact_duplicates(stored, key=key, text=text, row=row)
    return without(stored, settle(found.filter(~F.col("kept")).select("_row"), "dropped"), row)
