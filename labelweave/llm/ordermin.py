"""Near duplicates by Order MinHash.

The k-mers of a document are its runs of five words, each labelled with its number of earlier occurrences, so
labelled k-mers are unique. A sketch entry takes the few labelled k-mers with the smallest hashes under one hash
function, in text order; documents that share an entry are candidates. Similarity is that of the best
alignment of the labelled k-mers: with ``m`` of them matched in order, ``m / (n_a + n_b - m)``. An alignment of
that similarity stays within a band around the diagonal, and as labelled k-mers are unique it is the longest
increasing run of matching places inside the band. Texts with equal words are one node from the start.

Candidates are found without writing out all pairs of a bucket: every member is aligned with the bucket's
first, links make components, and only buckets that then still hold several components are compared further:
all pairs of different components, in blocks, of which only the links come out.

At a similarity of 0.8 a pair shares a given entry with probability 0.8^5, so 1 in 300,000 pairs share none of 32.

Defined cases: a NULL text is empty; texts without words form one class; a text of one to four words has one
k-mer of all its words; repeated rows are in one class; a class keeps the row with its smallest id, NULL last.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.llm.components import connected_components
from labelweave.llm.rows import arrow_rows, bounded, fresh, numbered, release, without
from labelweave.llm.words import Texts, Words, find_words, mix, text_chunks, window_hashes, word_hashes
from labelweave.scratch import settle

SHINGLE = 5
SIMILARITY = 0.8
#: Entries of a sketch, and k-mers in an entry.
ENTRIES, TAKEN = 32, 5
#: Documents of at most so many k-mers get further entries with fewer k-mers, as few edits change much there.
SHORT, SHORT_ENTRIES, SHORT_TAKEN = 24, 12, 2
#: Members of a bucket that are compared as one block, and k-mers that are counted at a time.
BLOCK = 512
#: Texts or sequences that Spark hands to Python at a time.
BATCH_ROWS = 1_000
_COLUMNS = 4096

_rng = np.random.default_rng(20_231)
_ALL = ENTRIES + SHORT_ENTRIES
_FLIP = _rng.integers(0, 1 << 63, _ALL, dtype=np.uint64)[:, None]
_TIMES = (_rng.integers(0, 1 << 63, _ALL, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]


def labelled_kmers(texts: Texts, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Labelled k-mers of all texts in order, and the first of each text (one more than texts)."""
    hashes = word_hashes(texts, words)
    counts = words.counts()
    n = np.where(counts >= SHINGLE, counts - SHINGLE + 1, (counts > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(texts)), n)
    start = words.first[:-1][doc] + (np.arange(len(doc)) - first[:-1][doc])
    # Windows of a short text would reach into the next one: such texts are hashed by themselves.
    kmers = np.zeros(len(doc), np.uint64)
    whole = counts[doc] >= SHINGLE
    windows = window_hashes(hashes, SHINGLE)
    kmers[whole] = windows[start[whole]]
    for i in np.flatnonzero(~whole):
        a = start[i]
        kmers[i] = window_hashes(hashes[a : a + counts[doc[i]]], int(counts[doc[i]]))[0]
    grouped = kmers ^ mix(doc.astype(np.uint64), 3)
    order = np.argsort(grouped, kind="stable")
    sorted_ = grouped[order]
    fresh_run = np.ones(len(order), bool)
    fresh_run[1:] = sorted_[1:] != sorted_[:-1]
    at = np.arange(len(order))
    seen = np.empty(len(order), np.uint64)
    seen[order] = (at - np.maximum.accumulate(np.where(fresh_run, at, 0))).astype(np.uint64)
    return np.where(seen > 0, mix(kmers ^ mix(seen, 4)), kmers), first


def _entries(kmers: np.ndarray, rows: slice, taken: int) -> np.ndarray:
    """Hash of the ``taken`` k-mers with the smallest hashes, in text order, for each hash function."""
    flip, times = _FLIP[rows], _TIMES[rows]
    places = None
    with np.errstate(over="ignore"):
        for a in range(0, len(kmers), 1 << 15):
            part = np.arange(a, min(a + (1 << 15), len(kmers)))
            best = np.broadcast_to(part, (len(flip), len(part)))
            if places is not None:
                best = np.concatenate([places, best], axis=1)
            if best.shape[1] > taken:
                values = (kmers[best] ^ flip) * times
                best = np.take_along_axis(best, np.argpartition(values, taken - 1, axis=1)[:, :taken], axis=1)
            places = best
        out = np.arange(rows.start, rows.stop, dtype=np.uint64)
        for place in np.sort(places, axis=1).T:
            out = mix(out * np.uint64(0x9FB21C651E98DF25) + kmers[place])
    return out


def sketch(kmers: np.ndarray) -> np.ndarray:
    """Entries of one document; each already depends on its hash function, so entries of all are one key space."""
    if not len(kmers):
        return np.zeros(0, np.uint64)
    out = _entries(kmers, slice(0, ENTRIES), TAKEN)
    if len(kmers) <= SHORT:
        out = np.concatenate([out, _entries(kmers, slice(ENTRIES, _ALL), SHORT_TAKEN)])
    return out


def _copy_keys(texts: Texts) -> list[bytes]:
    """Digest of the words of each text."""
    data = texts.data.tobytes()
    at = texts.offsets.tolist()
    return [hashlib.blake2b(b" ".join(data[a:b].split()), digest_size=16).digest() for a, b in zip(at[:-1], at[1:])]


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in text_chunks(batch.column(2)):
            kmers, first = labelled_kmers(texts, find_words(texts))
            sketches = [sketch(kmers[a:b]).view(np.int64) for a, b in zip(first[:-1], first[1:])]
            rows = slice(texts.first, texts.first + len(texts))
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sketches])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0)[rows],
                    batch.column(1)[rows],
                    pa.array(_copy_keys(texts), pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sketches))),
                ],
                ["row", "doc_id", "copy", "sketch"],
            )
    release()


def _sequence_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in text_chunks(batch.column(0)):
            kmers, first = labelled_kmers(texts, find_words(texts))
            short = (kmers >> np.uint64(32)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(_copy_keys(texts), pa.binary()),
                    pa.array([short[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary()),
                ],
                ["copy", "sequence"],
            )
    release()


def longest_increasing(places: np.ndarray) -> int:
    if len(places) < 2 or (places[1:] > places[:-1]).all():
        return len(places)
    tails: list[int] = []
    for p in places.tolist():
        at = bisect_left(tails, p)
        if at == len(tails):
            tails.append(p)
        else:
            tails[at] = p
    return len(tails)


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Matched over all k-mers of the best alignment inside the band of similarity ``least``; 0 if it cannot be."""
    total = len(a) + len(b)
    if not len(a) or not len(b) or min(len(a), len(b)) < least * max(len(a), len(b)) - 1e-9:
        return 0.0
    _, at_a, at_b = np.intersect1d(a, b, return_indices=True)
    # m matches leave total - 2m unmatched, and m >= least / (1 + least) * total.
    band = int(total * (1 - 2 * least / (1 + least))) + 1
    near = np.abs(at_a - at_b) <= band
    at_a, at_b = at_a[near], at_b[near]
    if len(at_a) < least * (total - len(at_a)) - 1e-9:
        return 0.0
    matched = longest_increasing(at_b[np.argsort(at_a)])
    return matched / (total - matched)


def _align_batches(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = [np.frombuffer(x.as_py(), np.uint32) for x in batch.column(2)]
            second = [np.frombuffer(x.as_py(), np.uint32) for x in batch.column(3)]
            similar = np.array([aligned_similarity(x, y, least) >= least for x, y in zip(first, second)], bool)
            keep = pa.array(similar)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])
        release()

    return run


def block_links(
    component: np.ndarray, sequences: list[np.ndarray], x: np.ndarray, y: np.ndarray, least: float
) -> list[tuple[int, int]]:
    """Places of pairs from ``x`` and ``y`` that are similar and join components not joined before.

    Shared k-mers are counted for all pairs by matrix products; they bound the similarity from above, so only
    pairs that may reach ``least`` are aligned, and of these only the ones still in different components.
    """
    counts = np.array([len(s) for s in sequences])
    distinct = [np.unique(s) for s in sequences]
    owner = np.repeat(np.arange(len(distinct)), [len(s) for s in distinct])
    _, column, often = np.unique(np.concatenate(distinct), return_inverse=True, return_counts=True)
    shared_column = often > 1
    keep = shared_column[column]
    owner, column = owner[keep], (np.cumsum(shared_column) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(x), len(y)), np.float32)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        part = slice(*np.searchsorted(column, [a, a + _COLUMNS]))
        has = np.zeros((len(sequences), _COLUMNS), np.float32)
        has[owner[part], column[part] - a] = 1
        common += has[x] @ has[y].T
    total = counts[x][:, None] + counts[y][None, :]
    may = (common * (1 + least) >= least * total - 1e-3) & (component[x][:, None] != component[y][None, :])
    parent = {c: c for c in component.tolist()}

    def find(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    links = []
    for i, j in zip(*(k.tolist() for k in np.nonzero(may))):
        i, j = int(x[i]), int(y[j])
        one, two = find(int(component[i])), find(int(component[j]))
        if one != two and aligned_similarity(sequences[i], sequences[j], least) >= least:
            parent[two] = one
            links.append((i, j))
    return links


def _block_batches(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for same, members in zip(batch.column(0).to_pylist(), batch.column(1)):
                members = members.values
                node = members.field("node").to_pylist()
                side = members.field("side").to_numpy()
                every = np.arange(len(node))
                x, y = (every, every) if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
                sequences = [np.frombuffer(s.as_py(), np.uint32) for s in members.field("sequence")]
                links = block_links(members.field("component").to_numpy(), sequences, x, y, least)
                found += [(node[i], node[j]) for i, j in links]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"]
            )
        release()

    return run


def _residual_links(members: DataFrame, sequences: DataFrame, components: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that the first members missed: buckets with several components, compared in blocks."""
    placed = members.join(components, "node", "left").select(
        "entry", "node", F.coalesce("component", "node").alias("component")
    )
    mixed = settle(
        placed.groupBy("entry")
        .agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
        # The one pair of a bucket of two has been aligned.
        .filter("low != high AND n > 2")
        .select("entry", F.ceil(F.col("n") / BLOCK).alias("blocks")),
        "mixed",
    )
    inside = placed.join(mixed, "entry").join(sequences, "node")
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    # Block i meets each block j: as side 0 of the pairs (i, j), i <= j, and as side 1 of the pairs (j, i), j < i.
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("_other")
    dealt = inside.withColumn("_block", block).select("entry", "node", "component", "sequence", "_block", other)
    grouped = (
        dealt.withColumn("_i", F.least("_block", "_other"))
        .withColumn("_j", F.greatest("_block", "_other"))
        .groupBy("entry", "_i", "_j")
        .agg(
            F.collect_list(
                F.struct("node", "component", (F.col("_block") > F.col("_other")).cast("int").alias("side"), "sequence")
            ).alias("members")
        )
        .select((F.col("_i") == F.col("_j")).alias("same"), "members")
    )
    return grouped.mapInArrow(_block_batches(least), "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    row: str | None = None,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """(doc_id, class_id, class_size, kept, _row) for each row; ``class_id`` is the smallest id of the class.

    Texts are read twice: for sketches, and for the k-mers of documents that have a candidate.
    """
    rows = docs.select(
        (docs[row] if row else F.monotonically_increasing_id()).alias("row"),
        docs[key].cast("long").alias("doc_id"),
        docs[text].alias("text"),
    )
    spark = docs.sparkSession
    with arrow_rows(spark, BATCH_ROWS):
        sketched = settle(
            rows.mapInArrow(_sketch_batches, "row long, doc_id long, copy binary, sketch array<long>"), "sketches"
        )
    nodes = settle(
        sketched.groupBy("copy")
        .agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first"),
            F.count("*").alias("copies"),
            F.first("sketch").alias("sketch"),
        )
        .select("copy", F.col("first.row").alias("node"), F.col("first.doc_id").alias("first_id"), "copies", "sketch"),
        "nodes",
    )
    entries = nodes.select("node", F.explode("sketch").alias("entry"))
    buckets = entries.groupBy("entry").agg(F.min("node").alias("leader"), F.count("*").alias("n")).filter("n > 1")
    members = settle(entries.join(buckets.drop("n"), "entry"), "members")
    pairs = settle(
        members.filter("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "pairs"
    )
    # K-mers of the candidates, from a second look at their texts.
    candidates = settle(
        members.select("node").distinct().join(nodes.select("node", "copy", "first_id"), "node"), "candidates"
    )
    wanted = bounded(candidates.select(F.col("first_id").alias("doc_id")).distinct())
    texts = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi").select("text")
    with arrow_rows(spark, BATCH_ROWS):
        sequences = settle(
            texts.mapInArrow(_sequence_batches, "copy binary, sequence binary")
            .join(bounded(candidates.select("copy", "node")), "copy")
            .groupBy("node")
            .agg(F.first("sequence").alias("sequence")),
            "sequences",
        )

    first = sequences.select(F.col("node").alias("a"), F.col("sequence").alias("first"))
    second = sequences.select(F.col("node").alias("b"), F.col("sequence").alias("second"))
    both = pairs.join(second, "b").join(first, "a").select("a", "b", "first", "second")
    with arrow_rows(spark, BATCH_ROWS):
        links = settle(both.mapInArrow(_align_batches(similarity), "a long, b long"), "links")
    components = connected_components(links)
    more = settle(_residual_links(members.select("entry", "node"), sequences, components, similarity), "links")
    if not more.isEmpty():
        components = connected_components(links.unionByName(more))
    placed = nodes.join(components, "node", "left").select(
        "copy", "node", "first_id", "copies", F.coalesce("component", "node").alias("component")
    )
    classes = placed.groupBy("component").agg(
        F.min(F.struct(F.col("first_id").isNull().alias("no_id"), "first_id", "node")).alias("best"),
        F.sum("copies").alias("class_size"),
    )
    by_copy = settle(
        placed.join(classes, "component").select(
            "copy", F.col("best.first_id").alias("class_id"), "class_size", F.col("best.node").alias("kept_row")
        ),
        "classes",
    )
    return sketched.select("row", "doc_id", "copy").join(by_copy, "copy").select(
        "doc_id", "class_id", "class_size", (F.col("row") == F.col("kept_row")).alias("kept"), F.col("row").alias("_row")
    )


def keep_one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class; all columns stay."""
    row = fresh(docs, "_row")
    stored = numbered(docs, row)
    found = near_duplicates(stored, key=key, text=text, row=row)
    return without(stored, settle(found.filter(~F.col("kept")).select("_row"), "dropped"), row)
