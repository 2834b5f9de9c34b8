"""Substring dedup by windows of words, partitioned by prefixes.

A suffix starts at each word that has ``window`` words of its document from there on; its head is those words.
Suffixes are partitioned by prefixes of variable length: counts of all suffixes by a two-word prefix decide how
many words of prefix a group needs, so that every group fits in memory. A group is sorted by the hashes of its
heads, in place of a suffix tree: equal heads are the repeats, and nothing deeper than a window is compared. All
occurrences but the first (smallest id, then earliest start) are removed. Each head learns its first place, and
windows that follow one another here and at their first places are put together: such a stretch is as long as it
can be to both sides, and is given with the place where it occurs first. Stretches overlap where a window's first
place is another one than its neighbour's.

Three things keep the volume small, and lose nothing:

* Documents are dealt into blocks of some megabytes. Heads that occur more than once in a block leave it once,
  so a passage that a third of all documents share costs one suffix for each block.
* Equal heads have equal runs of ``_ANCHOR`` words, hence the same smallest hash of them (anchor). Suffixes
  whose anchor occurs once in the corpus cannot repeat and stay in their block.
* Texts are shuffled once; the three passes over the blocks read the same exchange.

Heads are told apart by 128-bit hashes of their words.

Defined cases: a NULL text has no words; documents shorter than a window keep everything; NULL ids come last;
rows with equal ids are separate documents in a fixed order, but one place where stretches are put together;
repeated rows lose all but the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.llm.words import (
    Texts,
    Words,
    covered,
    find_words,
    mix,
    text_chunks,
    window_hashes,
    window_starts,
    word_hashes,
)

WINDOW = 20
#: Words of an anchor.
_ANCHOR = 8
#: Two-word prefixes are counted in so many classes.
PREFIX_CLASSES = 4096
#: Suffixes of a group, anchors of a range and bytes of a block, on average at most.
GROUP_SUFFIXES, RANGE_SUFFIXES, BLOCK_BYTES = 1_000_000, 4_000_000, 2 << 20
_LAST = np.iinfo(np.int64).max


def prefix_class(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Class of the two-word prefix at each start."""
    pair = mix(hashes[starts] * np.uint64(3) + hashes[np.minimum(starts + 1, len(hashes) - 1)])
    return (pair % np.uint64(PREFIX_CLASSES)).astype(np.int64)


def _count_batches(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, size = np.zeros(PREFIX_CLASSES, np.int64), 0
        for batch in batches:
            for texts in text_chunks(batch.column(0)):
                words = find_words(texts)
                starts = window_starts(words, window)
                if len(starts):
                    counts += np.bincount(prefix_class(word_hashes(texts, words), starts), minlength=PREFIX_CLASSES)
                size += len(texts.data)
        yield pa.RecordBatch.from_arrays([pa.array([counts.tolist()]), pa.array([size])], ["counts", "size"])

    return run


class PrefixPlan:
    """Group of each suffix: classes in order, each with a prefix length and the number of groups it needs."""

    def __init__(self, counts: np.ndarray, limit: int, window: int = WINDOW):
        self.parts = np.maximum(1, -(-counts // limit))
        # A class that needs more groups is told apart by more words.
        self.length = np.select([self.parts == 1, self.parts <= 64, self.parts <= 4096], [2, 4, 8], 16)
        self.length = np.minimum(self.length, window)
        single = np.where(self.parts == 1, counts, limit)
        # Small classes share a group until it is full.
        filled = np.cumsum(single) // limit
        self.first = np.cumsum(np.concatenate([[0], np.maximum(np.diff(filled), self.parts[1:] > 1)]))
        self.first = self.first + np.concatenate([[0], np.cumsum(self.parts[:-1] - 1)])

    def groups(self, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        which = prefix_class(hashes, starts)
        out = self.first[which].copy()
        for length in np.unique(self.length[which]).tolist():
            mine = np.flatnonzero((self.length[which] == length) & (self.parts[which] > 1))
            if len(mine):
                prefix = window_hashes(hashes, length)[starts[mine]]
                out[mine] += (prefix % self.parts[which[mine]].astype(np.uint64)).astype(np.int64)
        return out


class Block:
    """The documents of a block in a fixed order, with their heads and anchors."""

    def __init__(self, table: pa.Table, window: int):
        table = table.select(["doc_id", "text", "tie"]).combine_chunks()
        order = np.lexsort(
            (
                table["tie"].to_numpy(),
                table["doc_id"].fill_null(_LAST).to_numpy(),
                table["doc_id"].is_null().to_numpy(),
            )
        )
        table = table.take(pa.array(order))
        self.doc_id = table["doc_id"].combine_chunks()
        column = table["text"].combine_chunks()
        self.texts = next(text_chunks(column, 1 << 62), Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64), 0))
        self.words: Words = find_words(self.texts)
        self.hashes = word_hashes(self.texts, self.words)
        self.window = window
        self.starts = window_starts(self.words, window)

    def heads(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each head."""
        if not len(self.starts):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        one = window_hashes(self.hashes, self.window)[self.starts]
        two = window_hashes(mix(self.hashes, 5), self.window, 0xA0761D6478BD642F)[self.starts]
        return one, two

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Anchor of each head, and the hashes of the runs of anchor length inside documents."""
        size = min(_ANCHOR, self.window)
        runs = window_hashes(self.hashes, size)
        inside = runs[window_starts(self.words, size)] if len(runs) else runs
        if not len(self.starts):
            return np.zeros(0, np.uint64), inside
        width, low, span = self.window - size + 1, runs, 1
        while span * 2 <= width:
            low = np.minimum(low[: len(low) - span], low[span:])
            span *= 2
        rest = width - span
        low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
        return low[self.starts], inside

    def offsets(self) -> np.ndarray:
        """Place of each head in its document, in words."""
        return self.starts - self.words.first[self.words.doc[self.starts]]

    def first_heads(self, heads: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """For each head the first of its kind in the block."""
        order = np.lexsort((np.arange(len(heads[0])), heads[1], heads[0]))
        one, two = heads[0][order], heads[1][order]
        new = np.ones(len(order), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        out = np.empty(len(order), np.int64)
        out[order] = order[new][np.cumsum(new) - 1]
        return out


def _split(by: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[list[bytes]]]:
    """Values of ``by`` that occur, and the bytes of each column for each of them, order kept."""
    order = np.argsort(by, kind="stable")
    names, starts = np.unique(by[order], return_index=True)
    bounds = [*starts.tolist(), len(by)]
    parts = [[c[order][a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])] for c in columns]
    return names, parts


_ANCHORS = "range int, block long, hashes binary, often binary"


def _block_anchors(window: int, ranges: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        block = Block(table, window)
        anchors, runs = block.anchors()
        wanted = np.unique(anchors)
        found = np.searchsorted(wanted, runs[: len(runs) if len(wanted) else 0])
        found = np.minimum(found, max(len(wanted) - 1, 0))
        found = found[wanted[found] == runs[: len(found)]]
        counts = np.minimum(np.bincount(found, minlength=len(wanted)), 2).astype(np.uint8)
        names, (hashes, often) = _split((mix(wanted, 6) % np.uint64(ranges)).astype(np.int32), wanted, counts)
        return pa.table(
            {
                "range": pa.array(names, pa.int32()),
                "block": pa.array([key[0].as_py()] * len(names), pa.int64()),
                "hashes": pa.array(hashes, pa.binary()),
                "often": pa.array(often, pa.binary()),
            }
        )

    return run


def _repeated_anchors(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of a range that occur at two places or more, back to each block that has them."""
    blocks, hashes, often = [], [], []
    for batch in batches:
        for b, h, o in zip(batch["block"].to_pylist(), batch["hashes"], batch["often"]):
            hashes.append(np.frombuffer(h.as_py(), np.uint64))
            often.append(np.frombuffer(o.as_py(), np.uint8))
            blocks.append(np.full(len(hashes[-1]), b, np.int64))
    block, hashed, count = np.concatenate(blocks), np.concatenate(hashes), np.concatenate(often).astype(np.int64)
    order = np.argsort(hashed, kind="stable")
    block, hashed, count = block[order], hashed[order], count[order]
    starts = np.flatnonzero(np.diff(hashed, prepend=~hashed[:1]))
    sizes = np.diff(np.append(starts, len(hashed)))
    again = np.repeat(np.add.reduceat(count, starts) > 1, sizes) if len(starts) else np.zeros(0, bool)
    names, (parts,) = _split(block[again], hashed[again])
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(parts, pa.binary())], ["block", "hashes"])


_SUFFIXES = "group long, block long, one binary, two binary, doc binary, place binary, offset binary"


def _block_suffixes(window: int, plan: PrefixPlan):
    def run(key: tuple, table: pa.Table, back: pa.Table) -> pa.Table:
        empty = [[], [], [], [], []]
        names = np.zeros(0, np.int64)
        if table.num_rows and back.num_rows:
            block = Block(table, window)
            repeated = np.sort(np.concatenate([np.frombuffer(h.as_py(), np.uint64) for h in back["hashes"]]))
            anchors, _ = block.anchors()
            at = np.minimum(np.searchsorted(repeated, anchors), len(repeated) - 1)
            heads = block.heads()
            first = block.first_heads(heads) == np.arange(len(anchors))
            leave = np.flatnonzero((repeated[at] == anchors) & first)
            starts = block.starts[leave]
            ids = block.doc_id.fill_null(_LAST).to_numpy()[block.words.doc[starts]] if len(starts) else np.zeros(0, np.int64)
            names, empty = _split(
                plan.groups(block.hashes, starts) if len(starts) else np.zeros(0, np.int64),
                heads[0][leave], heads[1][leave], ids, leave.astype(np.uint32), block.offsets()[leave].astype(np.uint32),
            )
        return pa.table(
            {
                "group": pa.array(names, pa.int64()),
                "block": pa.array([key[0].as_py()] * len(names), pa.int64()),
                **{c: pa.array(p, pa.binary()) for c, p in zip(("one", "two", "doc", "place", "offset"), empty)},
            }
        )

    return run


_MARKS = "block long, places binary, first_doc binary, first_offset binary"


def _subtree(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes whose head an earlier suffix has, back to their blocks with the place of the first one."""
    kinds = {"one": np.uint64, "two": np.uint64, "doc": np.int64, "place": np.uint32, "offset": np.uint32}
    parts: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        for b, *columns in zip(batch["block"].to_pylist(), *(batch[c] for c in kinds)):
            read = [np.frombuffer(c.as_py(), kind) for c, kind in zip(columns, kinds.values())]
            parts.append((np.full(len(read[0]), b, np.int64), *read))
    block, one, two, doc, place, offset = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((block, doc, two, one))
    later = np.zeros(len(order), bool)
    later[1:] = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
    first = order[~later][np.cumsum(~later) - 1][later]
    order = order[later]
    names, parts_back = _split(block[order], place[order], doc[first], offset[first])
    arrays = [pa.array(names, pa.int64()), *(pa.array(x, pa.binary()) for x in parts_back)]
    yield pa.RecordBatch.from_arrays(arrays, ["block", "places", "first_doc", "first_offset"])


_KEPT = (
    "doc_id long, n_words long, n_removed long, kept_text string, "
    "repeats array<struct<start:long,end:long,first_id:long,first_start:long>>"
)


def _stretches(block: Block, removed: np.ndarray, doc: np.ndarray, offset: np.ndarray) -> pa.Array:
    """Lists, one for each document, of runs of removed windows whose first places are a run as well."""
    at = np.flatnonzero(removed)
    own = block.words.doc[block.starts[at]]
    here, doc, offset = block.offsets()[at], doc[at], offset[at]
    goes_on = np.zeros(len(at), bool)
    goes_on[1:] = (np.diff(own) == 0) & (np.diff(here) == 1) & (np.diff(offset) == 1) & (doc[1:] == doc[:-1])
    opens = np.flatnonzero(~goes_on)
    closes = np.append(opens[1:], len(at))[: len(opens)] - 1
    first_id = pa.array(doc[opens], mask=doc[opens] == _LAST)
    fields = [here[opens], here[closes] + block.window, first_id, offset[opens]]
    spans = pa.StructArray.from_arrays(
        [pa.array(x, pa.int64()) for x in fields], ["start", "end", "first_id", "first_start"]
    )
    bounds = np.searchsorted(own[opens], np.arange(len(block.doc_id) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), spans)


def _block_kept(window: int):
    def run(key: tuple, table: pa.Table, marks: pa.Table) -> pa.Table:
        block = Block(table, window)
        first = block.first_heads(block.heads())
        removed = first != np.arange(len(first))
        # First places: in the block, unless another block has an earlier one.
        doc = block.doc_id.fill_null(_LAST).to_numpy()[block.words.doc[block.starts]]
        offset = block.offsets()
        for places, docs, offsets in zip(marks["places"], marks["first_doc"], marks["first_offset"]):
            at = np.frombuffer(places.as_py(), np.uint32)
            removed[at] = True
            doc[at] = np.frombuffer(docs.as_py(), np.int64)
            offset[at] = np.frombuffer(offsets.as_py(), np.uint32)
        gone = covered(block.starts[removed], window, len(block.hashes))
        words, data = block.words, block.texts.data.tobytes()
        bounds = list(zip(words.starts.tolist(), words.ends.tolist()))
        sums = np.concatenate([[0], np.cumsum(gone)])
        n_removed = (sums[words.first[1:]] - sums[words.first[:-1]]).astype(np.int64)
        kept, ends = [], block.texts.offsets.tolist()
        for d, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
            if not n_removed[d]:
                kept.append(b" ".join(data[ends[d] : ends[d + 1]].split()))
            else:
                kept.append(b" ".join([data[s:e] for (s, e), g in zip(bounds[a:b], gone[a:b].tolist()) if not g]))
        return pa.table(
            {
                "doc_id": block.doc_id,
                "n_words": words.counts().astype(np.int64),
                "n_removed": n_removed,
                "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
                "repeats": _stretches(block, removed, doc[first], offset[first]),
            }
        )

    return run


def remove_repeats(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    group_suffixes: int = GROUP_SUFFIXES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, repeats) for each row.

    ``repeats`` are the repeated stretches as word places (end exclusive), with the id of the document that has the
    stretch first and its place there. The driver gets ``PREFIX_CLASSES`` counts from one pass that shuffles one row
    for each task.
    """
    body = F.coalesce(docs[text], F.lit(""))
    counted = docs.select(body.alias("text")).mapInArrow(_count_batches(window), "counts array<long>, size long")
    found = (
        counted.select("size", F.posexplode("counts").alias("at", "n"))
        .groupBy("at")
        .agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
        .collect()
    )
    counts = np.zeros(PREFIX_CLASSES, np.int64)
    for r in found:
        counts[r["at"]] = r["n"]
    size = found[0]["size"] if found else 0
    plan = PrefixPlan(counts, group_suffixes, window)
    blocks = max(1, -(-size // block_bytes))
    ranges = max(16, -(-int(counts.sum()) // RANGE_SUFFIXES))

    dealt = docs.select(docs[key].cast("long").alias("doc_id"), body.alias("text")).withColumn("tie", F.xxhash64("text"))
    by_block = dealt.withColumn("block", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(blocks))).repartition("block")
    anchors = by_block.groupBy("block").applyInArrow(_block_anchors(window, ranges), _ANCHORS)
    repeated = anchors.groupBy("range").applyInArrow(_repeated_anchors, "block long, hashes binary")
    suffixes = (
        by_block.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(_block_suffixes(window, plan), _SUFFIXES)
    )
    marks = suffixes.groupBy("group").applyInArrow(_subtree, _MARKS)
    return by_block.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(_block_kept(window), _KEPT)
