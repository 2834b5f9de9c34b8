"""Random forests of sparse vectors, node for node those of MLlib.

MLlib keeps a dense integer for every feature of a row (some 60,000 here) and adds up dense counters. Here a block of
rows is packed once, entries beside a feature's bin of zero only, and shared by all labels. A pass places the rows in
the trees, counts the entries of each open node's features, and sends only counters that are not zero; the bin of
zero gets what is left of the node's total. Thresholds, bags, feature subsets, the order of nodes and all arithmetic
follow MLlib, so that its model reads the nodes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from threading import Lock

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, StorageLevel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.scratch import python_rows, scratch_path

#: Rows that Spark hands to Python at a time while blocks are packed.
ROWS_AT_A_TIME = 1_000
#: Features whose thresholds are found in one call.
FEATURES_AT_A_TIME = 2_048
#: Nodes that are counted and judged at a time, and the counters that they may have.
NODES_AT_A_TIME = 64
COUNTERS_AT_A_TIME = 1 << 20
#: Feature subsets that one task draws, how many tasks draw at a time, and how many of such waves are kept.
DRAWS_AT_A_TIME = 2_048
DRAW_TASKS = 8
KEPT_WAVES = 3
#: Rows from which MLlib takes thresholds, and the gain of a split that it refuses.
SPLIT_ROWS = 10_000
REFUSED = -np.finfo(np.float64).max
_EPSILON = np.finfo(np.float64).eps
_PLACE = (1 << 33) - 1
_NODE_SCHEMA = (
    "treeID int, nodeData struct<id:int, prediction:double, impurity:double, impurityStats:array<double>, "
    "rawCount:bigint, gain:double, leftChild:int, rightChild:int, "
    "split:struct<featureIndex:int, leftCategoriesOrThreshold:array<double>, numCategories:int>>"
)


# Random numbers of the JVM


def next_longs(seed: int, start: int, count: int) -> np.ndarray:
    """``nextLong`` of ``java.util.Random(seed)``, from the one with number ``start``."""
    mask, a, c = (1 << 48) - 1, 0x5DEECE66D, 0xB
    state, power, add, steps = (seed ^ a) & mask, a, c, 2 * start
    while steps:  # steps at once: the generator is linear
        if steps & 1:
            state = (state * power + add) & mask
        add = (add * (power + 1)) & mask
        power = (power * power) & mask
        steps >>= 1
    found = np.empty(count, np.uint64)
    for i in range(count):
        state = (state * a + c) & mask
        high = state >> 16
        state = (state * a + c) & mask
        low = state >> 16
        found[i] = ((high << 32) + low - ((low & 0x80000000) << 1)) & 0xFFFFFFFFFFFFFFFF
    return found


def _murmur(low: np.ndarray, high: np.ndarray, seed) -> np.ndarray:
    """Scala's ``MurmurHash3.bytesHash`` of eight bytes, given as two numbers."""
    def rotated(x, k):
        return (x << np.uint32(k)) | (x >> np.uint32(32 - k))

    h = np.broadcast_to(np.asarray(seed, np.uint32), low.shape).copy()
    for block in (low, high):
        k = rotated(block * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = rotated(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


def xorshift_states(seeds: np.ndarray) -> np.ndarray:
    """First states of Spark's ``XORShiftRandom``."""
    swapped = seeds.byteswap()
    low, high = swapped.astype(np.uint32), (swapped >> np.uint64(32)).astype(np.uint32)
    lower = _murmur(low, high, 0x3C074A61)
    return (_murmur(low, high, lower).astype(np.uint64) << np.uint64(32)) | lower.astype(np.uint64)


def reservoirs(seeds: np.ndarray, width: int, size: int) -> np.ndarray:
    """``SamplingUtils.reservoirSampleAndCount`` of the numbers below ``width``: ``size`` of them for each seed."""
    found = np.tile(np.arange(size, dtype=np.int32), (len(seeds), 1))
    state, moved, value = xorshift_states(seeds), np.empty(len(seeds), np.uint64), np.empty(len(seeds), np.float64)
    first = np.empty(len(seeds), np.uint64)
    left, right, back = np.uint64(21), np.uint64(35), np.uint64(4)

    def step() -> None:
        np.left_shift(state, left, out=moved)
        np.bitwise_xor(state, moved, out=state)
        np.right_shift(state, right, out=moved)
        np.bitwise_xor(state, moved, out=state)
        np.left_shift(state, back, out=moved)
        np.bitwise_xor(state, moved, out=state)

    low26, low27, shift = np.uint64((1 << 26) - 1), np.uint64((1 << 27) - 1), np.uint64(27)
    for item in range(size, width):
        step()
        np.bitwise_and(state, low26, out=first)
        np.left_shift(first, shift, out=first)
        step()
        np.bitwise_and(state, low27, out=moved)
        np.bitwise_or(first, moved, out=first)
        np.multiply(first, 2.0**-53, out=value)
        np.multiply(value, item + 1.0, out=value)
        hit = np.flatnonzero(value < size)
        if len(hit):
            found[hit, value[hit].astype(np.int64)] = item
    return found


def well_doubles(seed: int, count: int) -> np.ndarray:
    """``nextDouble`` of ``Well19937c(seed)``, the generator of Spark's bags."""
    signed = [x - (1 << 32) if x >> 31 else x for x in ((seed >> 32) & 0xFFFFFFFF, seed & 0xFFFFFFFF)]
    for i in range(2, 624):
        x = (1812433253 * (signed[i - 2] ^ (signed[i - 2] >> 30)) + i) & 0xFFFFFFFF
        signed.append(x - (1 << 32) if x >> 31 else x)
    start = np.array(signed, np.int64).astype(np.uint32)
    run, mask = 70, 0xFFFFFFFF  # the nearest earlier word that a step reads is 70 steps back, but for the last one
    steps = -(-2 * count // run) * run
    words, out = np.empty(623 + steps, np.uint32), np.empty(steps, np.uint32)
    words[:623] = start[:0:-1]
    last = int(start[0])
    u = [np.uint32(k) for k in range(32)]
    for t in range(0, steps, run):
        near, mid, far = (words[t + 623 - k : t + 623 - k + run] for k in (70, 179, 449))
        z0 = (words[t : t + run] & np.uint32(0x80000000)) ^ (words[t + 1 : t + 1 + run] & np.uint32(0x7FFFFFFF))
        a = near ^ (near >> u[27])
        z2 = (mid >> u[9]) ^ far ^ (far >> u[1])
        rest = z0 ^ (a << u[9]) ^ (a >> u[21]) ^ (z2 << u[21]) ^ (z2 >> u[21])
        row, before = [], last
        for x in rest.tolist():
            s = last ^ ((last << 25) & mask)
            last = x ^ ((s << 9) & mask) ^ (s >> 21)
            row.append(last)
        made = out[t : t + run]
        made[:] = row
        previous = np.empty(run, np.uint32)
        previous[0], previous[1:] = before, made[:-1]
        words[t + 623 : t + 623 + run] = previous ^ (previous << u[25]) ^ a ^ z2
    out ^= (out << u[7]) & np.uint32(0xE46E1700)
    out ^= (out << u[15]) & np.uint32(0x9B868000)
    out >>= u[6]
    pairs = out[: 2 * count].reshape(-1, 2).astype(np.uint64)
    return ((pairs[:, 0] << np.uint64(26)) | pairs[:, 1]) * 2.0**-52


def poisson_counts(seed: int, mean: float, count: int) -> np.ndarray:
    """``count`` samples of ``PoissonDistribution(mean)`` after ``reseedRandomGenerator(seed)``."""
    stop, made, share = math.exp(-mean), [], 1.1
    while len(made) < count:  # as many doubles as will do; the rare second turn starts over with more
        made, n, product = [], 0, 1.0
        for x in well_doubles(seed, int(share * (1 + mean) * count) + 1_000).tolist():
            product *= x
            if product >= stop:
                n += 1
            else:
                made.append(n)
                n, product = 0, 1.0
        share *= 1.5
    return np.array(made[:count], np.uint8)


def _improved(key: int) -> int:
    h = (key + ~((key << 9) & 0xFFFFFFFF)) & 0xFFFFFFFF
    h ^= h >> 14
    h = (h + (h << 4)) & 0xFFFFFFFF
    return h ^ (h >> 10)


def map_order(keys: list[int]) -> list[int]:
    """The order in which a Scala ``HashMap.toMap`` of these keys is walked; MLlib opens nodes in it."""
    if len(keys) <= 4:
        return sorted(keys, key=lambda k: (k & 15, k))

    def walk(some: list[int], shift: int) -> list[int]:
        places: dict[int, list[int]] = {}
        for k in some:
            places.setdefault((_improved(k) >> shift) & 31, []).append(k)
        alone = [places[p][0] for p in sorted(places) if len(places[p]) == 1]
        return alone + [k for p in sorted(places) if len(places[p]) > 1 for k in walk(places[p], shift + 5)]

    return walk(keys, 0)


# Thresholds and blocks


@dataclass
class Thresholds:
    """Thresholds of all features, one after the other; ``zero`` is the bin of the value 0."""

    start: np.ndarray
    values: np.ndarray
    zero: np.ndarray

    @property
    def splits(self) -> np.ndarray:
        return np.diff(self.start)


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the rows; row, feature and value of the entries that are not zero."""
    ids = batch.column("id").to_numpy()
    sizes = pa.compute.list_value_length(batch.column("indices")).to_numpy(zero_copy_only=False).astype(np.int64)
    features = batch.column("indices").flatten().to_numpy()
    values = batch.column("values").flatten().to_numpy()
    row, used = np.repeat(np.arange(len(ids)), sizes), values != 0
    return ids, row[used], features[used], values[used]


def _summed(features: np.ndarray, values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """The pairs in order, equal ones once."""
    order = np.lexsort((values, features))
    features, values, counts = features[order], values[order], counts[order]
    first = np.ones(len(features), bool)
    first[1:] = (features[1:] != features[:-1]) | (values[1:] != values[:-1])
    at = np.flatnonzero(first)
    return features[at], values[at], np.add.reduceat(counts, at) if len(at) else counts


def _sampled_values(chosen: np.ndarray | None):
    """(bucket, features, vals, counts): how often a value occurs in the chosen rows of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            ids, row, features, values = _entries(batch)
            if chosen is not None:
                used = np.isin(ids, chosen)[row]
                features, values = features[used], values[used]
            found.append(_summed(features, values, np.ones(len(features), np.int64)))
        if not found:
            return
        features, values, counts = _summed(*(np.concatenate(x) for x in zip(*found)))
        bucket = features // FEATURES_AT_A_TIME
        ends = np.flatnonzero(np.diff(bucket, append=-1)) + 1
        for start, end in zip([0, *ends[:-1]], ends):
            part = [x[start:end].tobytes() for x in (features.astype(np.int32), values, counts)]
            columns = [pa.array([int(bucket[start])], pa.int32()), *(pa.array([x], pa.binary()) for x in part)]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "features", "vals", "counts"])

    return run


def feature_thresholds(values: np.ndarray, counts: np.ndarray, expected: float, most: int) -> np.ndarray:
    """``RandomForest.findSplitsForContinuousFeature``: at most ``most`` thresholds of the sorted ``values``.

    ``expected`` is the number of sampled rows; those without an entry have the value 0.
    """
    weights, given = counts.astype(np.float64), float(counts.sum())
    if expected - given > _EPSILON * given * 100:
        at = int(np.searchsorted(values, 0.0))
        values, weights = np.insert(values, at, 0.0), np.insert(weights, at, expected - given)
    between = (values[:-1] + values[1:]) / 2.0
    if len(between) <= most:
        return between
    stride = expected / (most + 1)
    current, target, kept = weights[0], stride, []
    for i, weight in enumerate(weights[1:].tolist()):
        previous, current = current, current + weight
        if abs(previous - target) < abs(current - target):
            kept.append(between[i])
            target += stride
    return np.array(kept)


def _bucket_thresholds(expected: float, most: int):
    """(feature, thresholds) of the features of a bucket."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, parts = (np.int32, np.float64, np.int64), ([], [], [])
        for batch in batches:
            for name, kind, part in zip(("features", "vals", "counts"), kinds, parts):
                part += [np.frombuffer(x.as_buffer(), kind) for x in batch.column(name)]
        features, values, counts = _summed(*(np.concatenate(x) for x in parts))
        ends = np.flatnonzero(np.diff(features, append=-1)) + 1
        starts = np.concatenate([[0], ends[:-1]])
        found = [feature_thresholds(values[a:b], counts[a:b], expected, most).tobytes() for a, b in zip(starts, ends)]
        columns = [pa.array(features[starts]), pa.array(found, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["feature", "thresholds"])

    return run


def _sampled_ids(numbered: DataFrame, rows: int, seed: int) -> tuple[np.ndarray | None, float]:
    """The rows that MLlib takes thresholds from, and their share."""
    if rows <= SPLIT_ROWS:
        return None, 1.0
    share = SPLIT_ROWS / rows
    spark, ids = numbered.sparkSession, numbered.select("id")
    draw = spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
    sampled = spark._jsparkSession.createDataFrame(ids._jdf.javaRDD().sample(False, share, draw), ids._jdf.schema())
    return DataFrame(sampled, spark).toArrow().column("id").to_numpy(), share


def _packed(labels: list[str], limits: Broadcast, trees: int, rate: float, seed: int):
    """One row for a partition: its entries by feature and by row, as bins; labels; the bags of all trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, marks, block, rows = [], [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, row, features, values = _entries(batch)
            block, place = int(ids[0]) >> 33, (ids & _PLACE)
            found.append((place[row].astype(np.int32), features.astype(np.int32), values))
            marks.append(np.stack([batch.column(c).to_numpy() for c in labels]).astype(np.uint8))
            rows += batch.num_rows
        if not rows:
            return
        row, features, values = (np.concatenate(x) for x in zip(*found))
        found.clear()
        found_limits: Thresholds = limits.value
        order = np.argsort(features, kind="stable")
        ptr = np.searchsorted(features[order], np.arange(len(found_limits.zero) + 1))
        bins = np.empty(len(order), np.uint8)
        values = values[order]
        start = found_limits.start
        for f in np.flatnonzero(np.diff(ptr)):
            a, b = ptr[f], ptr[f + 1]
            bins[a:b] = np.searchsorted(found_limits.values[start[f] : start[f + 1]], values[a:b])
        row, features = row[order], features[order]
        used = bins != found_limits.zero[features]
        row, features, bins = row[used], features[used], bins[used]
        width = len(found_limits.zero)
        by_feature = np.searchsorted(features, np.arange(width + 1)).astype(np.int64)
        by_row = np.argsort(row, kind="stable")
        row_ptr = np.searchsorted(row[by_row], np.arange(rows + 1)).astype(np.int64)
        small = np.uint16 if max(rows, width) <= 1 << 16 else np.int32
        bags = poisson_counts(seed + block + 1, rate, rows * trees).reshape(rows, trees).T
        parts = [by_feature, row.astype(small), bins, row_ptr, features[by_row].astype(small), bins[by_row]]
        parts += [np.concatenate(marks, axis=1), np.ascontiguousarray(bags)]
        columns = [pa.array([rows], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)]
        yield pa.RecordBatch.from_arrays(columns, ["rows", *_PARTS])

    return run


_PARTS = ["ptr", "places", "bins", "row_ptr", "row_features", "row_bins", "labels", "bags"]


@dataclass
class Blocks:
    """Packed rows of a fit; ``draws`` are shared by its labels."""

    packed: DataFrame
    labels: list[str]
    thresholds: Thresholds
    sent: Broadcast
    width: int
    trees: int
    depth: int
    seed: int
    memory: int
    waves: dict[int, np.ndarray] = field(default_factory=dict)
    lock: Lock = field(default_factory=Lock)

    @property
    def per_node(self) -> int:
        return self.width if self.trees == 1 else math.ceil(math.sqrt(self.width))

    def close(self) -> None:
        self.packed.unpersist()
        self.sent.unpersist()

    def subset(self, draw: int) -> np.ndarray:
        """The features of the draw with this number."""
        size = DRAWS_AT_A_TIME * DRAW_TASKS
        with self.lock:
            if (wave := draw // size) not in self.waves:
                self.waves[wave] = self._drawn(wave * size)
                for old in sorted(self.waves)[:-KEPT_WAVES]:
                    if old != wave:
                        del self.waves[old]
            return self.waves[wave][draw % size]

    def _drawn(self, start: int) -> np.ndarray:
        spark, width, size = self.packed.sparkSession, self.width, self.per_node
        seeds = next_longs(self.seed, start, DRAWS_AT_A_TIME * DRAW_TASKS).reshape(DRAW_TASKS, -1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in batch.column(0).to_pylist():
                    drawn = pa.array([reservoirs(seeds[part], width, size).tobytes()], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), drawn], ["part", "drawn"])

        parts = spark.range(0, DRAW_TASKS, 1, DRAW_TASKS).mapInArrow(run, "part long, drawn binary").collect()
        found = [np.frombuffer(r.drawn, np.int32).reshape(-1, size) for r in sorted(parts, key=lambda r: r.part)]
        return np.concatenate(found).astype(np.uint16 if width <= 1 << 16 else np.int32)


def pack(rows: DataFrame, column: str, labels: list[str], estimator: RandomForestClassifier) -> Blocks:
    """Blocks of ``rows``, a partition each in its order, for the estimator's trees."""
    spark, count = rows.sparkSession, rows.count()
    parts = F.unwrap_udt(column)
    places = F.coalesce(parts.getField("indices"), F.sequence(F.lit(0), F.size(parts.getField("values")) - 1))
    numbered = rows.select(
        F.monotonically_increasing_id().alias("id"), places.alias("indices"), parts.getField("values").alias("values"), *labels
    )
    known = rows.schema[column].metadata.get("ml_attr", {}).get("num_attrs")
    width = int(known) if known is not None else len(rows.select(column).first()[0])
    seed, most = estimator.getSeed(), min(estimator.getMaxBins(), count) - 1
    chosen, share = _sampled_ids(numbered, count, seed)
    with python_rows(spark, ROWS_AT_A_TIME):
        sampled = numbered.mapInArrow(_sampled_values(chosen), "bucket int, features binary, vals binary, counts binary")
        buckets = max(1, min(-(-width // FEATURES_AT_A_TIME), 2 * spark.sparkContext.defaultParallelism))
        learned = sampled.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(
            _bucket_thresholds(share * count, most), "feature int, thresholds binary"
        ).toArrow()
        found = dict(zip(learned.column("feature").to_pylist(), learned.column("thresholds").to_pylist()))
        each = [np.frombuffer(found.get(f, b""), np.float64) for f in range(width)]
        start = np.concatenate([[0], np.cumsum([len(x) for x in each])])
        zero = np.array([np.searchsorted(x, 0.0) for x in each], np.uint8)
        thresholds = Thresholds(start, np.concatenate(each), zero)
        sent = spark.sparkContext.broadcast(thresholds)
        run = _packed(labels, sent, estimator.getNumTrees(), estimator.getSubsamplingRate(), seed)
        packed = numbered.mapInArrow(run, "rows int, " + ", ".join(f"{x} binary" for x in _PARTS))
        packed = packed.persist(StorageLevel.MEMORY_AND_DISK)
        packed.count()
    memory = estimator.getMaxMemoryInMB() << 20
    return Blocks(
        packed, labels, thresholds, sent, width, estimator.getNumTrees(), estimator.getMaxDepth(), seed, memory
    )


# Growing


@dataclass
class Nodes:
    """Nodes of all trees; the first ones are the roots."""

    tree: list[int]
    depth: list[int]
    parent: list[int]
    counts: list[tuple[int, int]]
    leaf: list[bool]
    valid: list[bool]
    gain: list[float]
    feature: list[int]
    bin: list[int]
    left: list[int]
    right: list[int]

    @staticmethod
    def roots(trees: int) -> Nodes:
        none = [-1] * trees
        return Nodes(
            list(range(trees)), [0] * trees, none[:], [(0, 0)] * trees, [True] * trees, [True] * trees, none[:], none[:],
            none[:], none[:], none[:],
        )

    def add(self, parent: int, counts: tuple[int, int]) -> int:
        plain = (self.gain, self.feature, self.bin, self.left, self.right)
        for values in plain:
            values.append(-1)
        self.tree.append(self.tree[parent])
        self.depth.append(self.depth[parent] + 1)
        self.parent.append(parent)
        self.counts.append(counts)
        self.leaf.append(True)
        self.valid.append(True)
        return len(self.tree) - 1


@dataclass
class Group:
    """What a pass sends to its tasks: the trees so far, the open nodes and their features."""

    tree: np.ndarray
    depth: np.ndarray
    parent: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    open: np.ndarray
    subsets: np.ndarray
    label: int
    bins: int

    @property
    def step(self) -> int:
        """Nodes that are counted at a time."""
        return max(1, min(NODES_AT_A_TIME, COUNTERS_AT_A_TIME // max(1, 2 * self.subsets.shape[1] * self.bins)))


def _spans(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and place of the entries of spans."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _gini(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    total = first + second
    with np.errstate(invalid="ignore", divide="ignore"):
        a, b = first / total, second / total
        return np.where(total == 0, 0.0, (1.0 - a * a) - b * b)


def _placed(group: Group, trees: np.ndarray, zero: np.ndarray, rows: int, ptr, places, bins) -> np.ndarray:
    """The node of each row in each of the ``trees``, as far as it is above an open node."""
    above = np.zeros(len(group.tree), bool)
    nodes = group.open
    while len(nodes):
        nodes = np.unique(group.parent[nodes])
        nodes = nodes[nodes >= 0]
        above[nodes] = True
    at_tree = np.full(int(trees.max()) + 1, -1)
    at_tree[trees] = np.arange(len(trees))
    current = np.repeat(trees.astype(np.int32), rows).reshape(len(trees), rows)
    for depth in range(int(group.depth[group.open].max())):
        inner = np.flatnonzero(above & (group.depth == depth))
        feature, side = group.feature[inner], np.arange(len(group.tree), dtype=np.int32)
        side[inner] = np.where(zero[feature] <= group.bin[inner], group.left[inner], group.right[inner])
        moved = side[current]
        for part in range(0, len(inner), 1_024):
            some, f = inner[part : part + 1_024], feature[part : part + 1_024]
            owner, entry = _spans(ptr[f], ptr[f + 1] - ptr[f])
            at, row = at_tree[group.tree[some]][owner], places[entry]
            here = np.flatnonzero(current[at, row] == some[owner])
            at, row, node = at[here], row[here], some[owner[here]]
            moved[at, row] = np.where(bins[entry[here]] <= group.bin[node], group.left[node], group.right[node])
        current = moved
    return current


def _counted(sent: Broadcast, limits: Broadcast):
    """(part, codes, counts, totals): counters of a block that are not zero, for each run of open nodes."""

    def block(batch: pa.RecordBatch, i: int) -> Iterator[pa.RecordBatch]:
        group, zero = sent.value, limits.value.zero
        rows = batch.column("rows")[i].as_py()
        raw = {name: batch.column(name)[i].as_buffer() for name in _PARTS}
        small = np.uint16 if max(rows, len(zero)) <= 1 << 16 else np.int32
        kinds = (np.int64, small, np.uint8, np.int64, small, np.uint8, np.uint8, np.uint8)
        parts = [np.frombuffer(raw[name], kind) for name, kind in zip(_PARTS, kinds)]
        ptr, places, bins, row_ptr, row_features, row_bins, labels, bags = parts
        y = labels.reshape(-1, rows)[group.label].astype(np.int64)
        trees = np.unique(group.tree[group.open])
        current = _placed(group, trees, zero, rows, ptr, places, bins)
        weight = bags.reshape(-1, rows)[trees]
        place = np.full(len(group.tree), -1, np.int32)
        place[group.open] = np.arange(len(group.open))
        active = place[current]
        current = None
        active[weight == 0] = -1
        pairs = np.flatnonzero(active.ravel() >= 0)
        mine = active.ravel()[pairs]
        order = np.argsort(mine, kind="stable")
        pairs, mine = pairs[order], mine[order]
        pair_row, pair_weight = pairs % rows, weight.ravel()[pairs].astype(np.int64)
        bounds = np.searchsorted(mine, np.arange(len(group.open) + 1))
        at_tree = np.full(int(trees.max()) + 1, -1)
        at_tree[trees] = np.arange(len(trees))
        step, size = group.step, group.subsets.shape[1]
        slots = np.full((step, len(zero)), -1, np.int32)
        per_row = np.diff(row_ptr)
        for start in range(0, len(group.open), step):
            nodes = np.arange(start, min(start + step, len(group.open)))
            low, high = bounds[nodes[0]], bounds[nodes[-1] + 1]
            if low == high:
                continue
            local, row, w = mine[low:high] - start, pair_row[low:high], pair_weight[low:high]
            totals = np.bincount(2 * local + y[row], weights=w, minlength=2 * step).astype(np.int64)
            subsets = group.subsets[nodes].astype(np.int64)
            by_column = (ptr[subsets + 1] - ptr[subsets]).sum(axis=1)
            by_row = np.bincount(local, weights=per_row[row], minlength=len(nodes))
            columns = by_column < by_row
            codes, counts = [], []
            few = np.flatnonzero(columns)
            if len(few):
                f = subsets[few].ravel()
                owner, entry = _spans(ptr[f], ptr[f + 1] - ptr[f])
                node, r = few[owner // size], places[entry]
                tree = at_tree[group.tree[group.open[nodes]]][node]
                here = np.flatnonzero(active[tree, r] == node + start)
                r, tree = r[here], tree[here]
                code = (node[here] * size + owner[here] % size) * group.bins + bins[entry[here]]
                codes.append(2 * code + y[r])
                counts.append(weight[tree, r])
            many = np.flatnonzero(~columns[local])
            if len(many):
                wanted = np.flatnonzero(~columns)
                slots[wanted[:, None], subsets[wanted]] = np.arange(size)
                r = row[many]
                owner, entry = _spans(row_ptr[r], per_row[r])
                node = local[many][owner]
                slot = slots[node, row_features[entry]]
                here = np.flatnonzero(slot >= 0)
                owner = owner[here]
                code = (node[here] * size + slot[here]) * group.bins + row_bins[entry[here]]
                codes.append(2 * code + y[r[owner]])
                counts.append(w[many][owner])
                slots[wanted[:, None], subsets[wanted]] = -1
            if codes:
                every = np.concatenate(codes)
                sums = np.bincount(every, weights=np.concatenate(counts))
                kept = np.flatnonzero(sums)
                found = (kept.astype(np.int32), sums[kept].astype(np.int32))
            else:
                found = (np.empty(0, np.int32), np.empty(0, np.int32))
            made = [pa.array([x.tobytes()], pa.binary()) for x in (*found, totals)]
            columns_out = [pa.array([start // step], pa.int32()), *made]
            yield pa.RecordBatch.from_arrays(columns_out, ["part", "codes", "counts", "totals"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from block(batch, i)

    return run


_BEST = "node int, feature int, bin int, gain double, l0 long, l1 long, t0 long, t1 long"


def best_splits(hist: np.ndarray, totals: np.ndarray, splits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``RandomForest.binsToBestSplit``: place of the best split of each node, its gain and the counts on its left.

    ``hist`` has (node, feature, bin, class) counts, ``splits`` the number of thresholds; of equal gains the first.
    """
    left = np.cumsum(hist, axis=2)[:, :, :-1]
    l0, l1 = left[..., 0].astype(np.float64), left[..., 1].astype(np.float64)
    t0, t1 = (totals[:, k].astype(np.float64)[:, None, None] for k in (0, 1))
    r0, r1 = t0 - l0, t1 - l1
    on_left, on_right = l0 + l1, r0 + r1
    total = on_left + on_right
    with np.errstate(invalid="ignore", divide="ignore"):
        gain = _gini(t0, t1) - on_left / total * _gini(l0, l1) - on_right / total * _gini(r0, r1)
        gain[~((on_left >= 1) & (on_right >= 1) & (gain >= 0))] = REFUSED
    gain[np.arange(gain.shape[2]) >= splits[:, :, None]] = -np.inf
    flat = gain.reshape(len(gain), -1)
    best = np.argmax(flat, axis=1)
    nodes = np.arange(len(gain))
    return best, np.maximum(flat[nodes, best], REFUSED), left.reshape(len(gain), -1, 2)[nodes, best]


def _judged(sent: Broadcast, limits: Broadcast):
    """The best split of each node of a run."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, zero, splits = sent.value, limits.value.zero, limits.value.splits
        step, size, start = group.step, group.subsets.shape[1], key[0].as_py() * group.step
        count = min(step, len(group.open) - start)
        hist = np.zeros(step * size * group.bins * 2, np.int64)
        totals = np.zeros(2 * step, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                codes, counts, some = (batch.column(c)[i].as_buffer() for c in ("codes", "counts", "totals"))
                hist[np.frombuffer(codes, np.int32)] += np.frombuffer(counts, np.int32)
                totals += np.frombuffer(some, np.int64)
        hist = hist.reshape(step, size, group.bins, 2)[:count]
        totals = totals.reshape(step, 2)[:count]
        subsets = group.subsets[start : start + count].astype(np.int64)
        nodes, slots = np.arange(count)[:, None], np.arange(size)[None]
        hist[nodes, slots, zero[subsets]] = totals[:, None] - hist.sum(axis=2)
        best, gain, left = best_splits(hist, totals, splits[subsets])
        feature = subsets[np.arange(count), best // (group.bins - 1)]
        found = [np.arange(start, start + count), feature, best % (group.bins - 1)]
        columns = [*(pa.array(x.astype(np.int32)) for x in found), pa.array(gain)]
        columns += [pa.array(x) for x in (left[:, 0], left[:, 1], totals[:, 0], totals[:, 1])]
        yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _BEST.split(", ")])

    return run


def _best_of(blocks: Blocks, nodes: Nodes, chosen: list[int], subsets: np.ndarray, label: int) -> dict[int, tuple]:
    """One pass: the best split of each chosen node that has rows."""
    spark = blocks.packed.sparkSession
    forest = [np.array(x, np.int32) for x in (nodes.tree, nodes.depth, nodes.parent, nodes.feature, nodes.bin, nodes.left, nodes.right)]
    bins = max(2, int(blocks.thresholds.splits.max()) + 1)
    group = Group(*forest, np.array(chosen, np.int32), subsets, label, bins)
    sent = spark.sparkContext.broadcast(group)
    try:
        counted = blocks.packed.mapInArrow(_counted(sent, blocks.sent), "part int, codes binary, counts binary, totals binary")
        parts = max(1, min(-(-len(chosen) // group.step), 2 * spark.sparkContext.defaultParallelism))
        judged = counted.repartition(parts, "part").groupBy("part").applyInArrow(_judged(sent, blocks.sent), _BEST).toArrow()
    finally:
        sent.unpersist()
    columns = [judged.column(i).to_pylist() for i in range(judged.num_columns)]
    return {row[0]: row[1:] for row in zip(*columns)}


def grow(blocks: Blocks, label: str) -> Nodes:
    """All trees of a label, in groups of open nodes as MLlib makes them up."""
    nodes, size, draw = Nodes.roots(blocks.trees), blocks.per_node, 0
    subsampled = size != blocks.width
    bins_of = blocks.thresholds.splits + 1
    everything = np.arange(blocks.width, dtype=np.int32)
    stack = list(range(blocks.trees))  # the next node is the last
    while stack:
        chosen, subsets, used = [], [], 0
        while stack:
            features = everything
            if subsampled:
                features, draw = blocks.subset(draw), draw + 1
            memory = 16 * int(bins_of[features].sum())
            if used and used + memory > blocks.memory:
                break
            chosen.append(stack.pop())
            subsets.append(features)
            used += memory
        found = _best_of(blocks, nodes, chosen, np.array(subsets), blocks.labels.index(label))
        by_tree: dict[int, list[int]] = {}
        for at, node in enumerate(chosen):
            by_tree.setdefault(nodes.tree[node], []).append(at)
        for tree in map_order(list(by_tree)):
            for at in by_tree[tree]:
                _split(nodes, chosen[at], found.get(at), blocks.depth, stack)
    return nodes


def _split(nodes: Nodes, node: int, best: tuple | None, most: int, stack: list[int]) -> None:
    """Make the node a leaf or give it children; those that may be split go on the stack."""
    feature, at, gain, l0, l1, t0, t1 = best or (-1, -1, REFUSED, 0, 0, *nodes.counts[node])
    nodes.counts[node], nodes.gain[node], nodes.valid[node] = (t0, t1), gain, gain != REFUSED
    if gain <= 0 or nodes.depth[node] == most:
        return
    nodes.leaf[node], nodes.feature[node], nodes.bin[node] = False, feature, at
    sides = [(l0, l1), (t0 - l0, t1 - l1)]
    nodes.left[node], nodes.right[node] = children = [nodes.add(node, counts) for counts in sides]
    for child, (a, b) in zip(children, sides):
        pure = abs(float(_gini(np.float64(a), np.float64(b)))) < _EPSILON
        if nodes.depth[child] < most and not pure:
            stack.append(child)


# Models


def _node_rows(nodes: Nodes, thresholds: Thresholds, trees: int) -> pa.Table:
    """The nodes as MLlib stores them: a tree from its root, left before right; twin leaves are one."""
    counts = np.array(nodes.counts, np.float64).reshape(-1, 2)
    impurity = _gini(counts[:, 0], counts[:, 1])
    predicted = counts[:, 1] > counts[:, 0]
    leaf = list(nodes.leaf)
    for node in range(len(leaf) - 1, -1, -1):  # children come after their parents
        if not leaf[node]:
            a, b = nodes.left[node], nodes.right[node]
            leaf[node] = leaf[a] and leaf[b] and predicted[a] == predicted[b]
    tree_ids, order, numbers = [], [], np.full(len(leaf), -1, np.int32)
    for tree in range(trees):
        first, todo = len(order), [tree]
        while todo:
            node = todo.pop()
            numbers[node] = len(order) - first
            order.append(node)
            if not leaf[node]:
                todo += [nodes.right[node], nodes.left[node]]
        tree_ids += [tree] * (len(order) - first)
    at = np.array(order)
    ends = np.array(leaf)[at]
    feature = np.where(ends, -1, np.array(nodes.feature)[at])
    inner = at[~ends]
    limits = thresholds.values[thresholds.start[np.array(nodes.feature)[inner]] + np.array(nodes.bin)[inner]]

    def lists(sizes: np.ndarray, values: np.ndarray) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))

    def children(given: list[int]) -> np.ndarray:
        return np.where(ends, -1, numbers[np.array(given)[at]]).astype(np.int32)

    split = {
        "featureIndex": feature.astype(np.int32), "leftCategoriesOrThreshold": lists(~ends, limits),
        "numCategories": np.full(len(at), -1, np.int32),
    }
    node = {
        "id": numbers[at], "prediction": predicted[at].astype(np.float64),
        "impurity": np.where(np.array(nodes.valid)[at], impurity[at], -1.0),
        "impurityStats": lists(np.full(len(at), 2), counts[at].ravel()), "rawCount": counts[at].sum(axis=1).astype(np.int64),
        "gain": np.where(ends, -1.0, np.array(nodes.gain, np.float64)[at]),
        "leftChild": children(nodes.left), "rightChild": children(nodes.right), "split": _struct(split),
    }
    return pa.table({"treeID": pa.array(tree_ids, pa.int32()), "nodeData": _struct(node)})


def _struct(columns: dict) -> pa.StructArray:
    return pa.StructArray.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], list(columns))


def forest_model(blocks: Blocks, nodes: Nodes, estimator: RandomForestClassifier) -> RandomForestClassificationModel:
    """The nodes as a model of the estimator: a forest of two rows is stored and gets them in place of its own."""
    spark, path = blocks.packed.sparkSession, scratch_path(blocks.packed.sparkSession, "forest")
    empty = Vectors.sparse(blocks.width, [], [])
    names = [estimator.getFeaturesCol(), estimator.getLabelCol()]
    estimator.fit(spark.createDataFrame([(empty, 0.0), (empty, 1.0)], names).coalesce(1)).write().save(path)
    rows = spark.createDataFrame(_node_rows(nodes, blocks.thresholds, blocks.trees), _NODE_SCHEMA)
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/data")
    return RandomForestClassificationModel.load(path)


def fit_forest(blocks: Blocks, label: str, estimator: RandomForestClassifier) -> RandomForestClassificationModel:
    """The model that ``estimator`` fits to the packed rows."""
    return forest_model(blocks, grow(blocks, label), estimator)
