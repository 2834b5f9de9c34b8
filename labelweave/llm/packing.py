"""Best-fit packing of documents into sequences of several permitted lengths.

Documents longer than the largest length are cut into pieces of it. Pieces are dealt into blocks of bounded
size; in a block they are placed longest first into the open bin with the least room that fits. Where none
fits, a new bin is opened with the permitted length whose cost for each word that can be expected in it is
least, so all lengths are planned together. At the end every bin is downsized to the smallest permitted length
that holds its contents.

Defined cases: a NULL or empty text has no words and no bin (bin, offset and capacity NULL, one row); rows
with equal ids are separate documents; equal lengths are placed in order of id, start and row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.llm.mixing import word_count
from labelweave.scratch import settle

#: Permitted lengths in words, and pieces in a block on average.
LENGTHS = (512, 1024, 2048, 4096)
BLOCK_PIECES = 8192


def bin_cost(length: int, scale: int = 8192) -> float:
    """Cost of a sequence: linear work, and attention that grows with the square."""
    return length * (1 + length / scale)


def pack(sizes: np.ndarray, lengths: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset and final capacity of each piece; ``sizes`` are given in the order of placement, descending."""
    largest = max(lengths)
    by_room: list[list[int]] = [[] for _ in range(largest + 1)]
    rooms = 0  # bit r is set if some open bin has room r
    filled: list[int] = []
    bins = np.empty(len(sizes), np.int64)
    offsets = np.empty(len(sizes), np.int64)
    # Words still to come from pieces of at most n words: a new bin cannot expect more.
    left = np.bincount(sizes, weights=sizes, minlength=largest + 1)
    coming = np.cumsum(left).astype(np.int64)
    costs = {length: bin_cost(length) for length in lengths}
    for i, size in enumerate(sizes.tolist()):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            room -= size
        else:
            best = None
            for length in lengths:
                if length >= size:
                    spare = length - size
                    later = max(0, int(coming[min(spare, size)]) - (size if spare >= size else 0))
                    each = costs[length] / (size + min(spare, later))
                    if best is None or each < best[0]:
                        best = (each, length)
            at, room = len(filled), best[1] - size
            filled.append(0)
        bins[i], offsets[i] = at, filled[at]
        filled[at] += size
        coming[size:] -= size
        if room:
            by_room[room].append(at)
            rooms |= 1 << room
    ladder = np.array(sorted(lengths))
    capacity = ladder[np.searchsorted(ladder, np.array(filled, np.int64))] if filled else ladder[:0]
    return bins, offsets, capacity[bins] if len(bins) else bins


_PACKED = (
    "doc_id long, piece int, start long, n_words long, bin long, bin_offset long, capacity int"
)


def _pack_block(lengths: Sequence[int]):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by(
            [("n_words", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("_row", "ascending")]
        )
        bins, offsets, capacity = pack(table["n_words"].to_numpy(), lengths)
        return pa.table(
            {
                "doc_id": table["doc_id"],
                "piece": table["piece"],
                "start": table["start"],
                "n_words": table["n_words"],
                "bin": (key[0].as_py() << 32) + bins,
                "bin_offset": offsets,
                "capacity": capacity.astype(np.int32),
            }
        )

    return run


def pack_documents(
    docs: DataFrame,
    lengths: Sequence[int] = LENGTHS,
    *,
    key: str = "doc_id",
    text: str = "text",
    block_pieces: int = BLOCK_PIECES,
) -> DataFrame:
    """(doc_id, piece, start, n_words, bin, bin_offset, capacity) for each piece of each document.

    ``start`` is the first word of the piece in its document, ``bin_offset`` its place in the bin. Texts are
    read once for their lengths; blocks hold narrow rows only.
    """
    lengths = sorted({int(n) for n in lengths})
    if not lengths or lengths[0] < 1:
        raise ValueError("lengths must be positive")
    largest = lengths[-1]
    sized = settle(
        docs.select(
            docs[key].cast("long").alias("doc_id"),
            word_count(docs[text]).alias("_size"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "lengths",
    )
    starts = F.sequence(F.lit(0).cast("long"), F.col("_size") - 1, F.lit(largest).cast("long"))
    pieces = sized.filter("_size > 0").select("doc_id", "_row", "_size", F.posexplode(starts).alias("piece", "start"))
    n_pieces = sized.agg(F.sum(F.ceil(F.col("_size") / largest))).first()[0] or 0
    blocks = max(1, math.ceil(n_pieces / block_pieces))
    dealt = pieces.select(
        "doc_id",
        "_row",
        "piece",
        "start",
        F.least(F.lit(largest).cast("long"), F.col("_size") - F.col("start")).alias("n_words"),
        F.pmod(F.xxhash64("doc_id", "piece", "_row"), F.lit(blocks)).alias("_block"),
    )
    packed = dealt.groupBy("_block").applyInArrow(_pack_block(lengths), _PACKED)
    none = lambda kind: F.lit(None).cast(kind)
    empty = sized.filter("_size = 0").select(
        "doc_id",
        F.lit(0).alias("piece"),
        F.lit(0).cast("long").alias("start"),
        F.lit(0).cast("long").alias("n_words"),
        none("long").alias("bin"),
        none("long").alias("bin_offset"),
        none("int").alias("capacity"),
    )
    return packed.unionByName(empty)
