from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from labelweave.operators import forest, train
from labelweave.operators.train import TrainParams, fit_family


def sparse_rows(spark, count, width, partitions, seed=5):
    """Word counts, weights with many values (some below 0) and a column without values; two labels."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(count):
        places = np.unique(rng.integers(0, width - 4, 12))
        entries = {int(p): float(rng.integers(1, 4)) * 0.7 for p in places}
        entries |= {width - 4: float(rng.normal()), width - 3: float(rng.integers(-1, 2)), width - 2: float(rng.random() < 0.3)}
        vector = Vectors.sparse(width, sorted((k, v) for k, v in entries.items() if v))
        if i % 7 == 0:
            vector = Vectors.dense(vector.toArray())
        a = float(entries.get(3, 0) + entries[width - 4] + rng.normal() > 0.5)
        rows.append((i, vector, a, float(rng.random() < 0.1 + 0.5 * (2 in entries))))
    df = spark.createDataFrame(rows, ["example_id", train.FEATURES, "a", "b"])
    return df.repartitionByRange(partitions, "example_id").sortWithinPartitions("example_id").drop("example_id")


def stored(spark, model, path):
    model.write().overwrite().save(path)
    return sorted(r.n for r in spark.read.parquet(f"{path}/data").select(F.to_json(F.struct("treeID", "nodeData")).alias("n")).collect())


@pytest.mark.parametrize("count, width, trees, depth, memory", [
    (600, 300, 12, 8, 256), (600, 300, 12, 8, 0), (700, 900, 30, 6, 1), (12_500, 12, 6, 6, 256), (300, 40, 1, 5, 256), (25, 5, 4, 3, 256),
])
def test_nodes_are_those_of_mllib(spark, tmp_path, count, width, trees, depth, memory):
    rows = sparse_rows(spark, count, width, 3).persist()
    if memory == 0:
        trees, depth = 3, 4  # a pass for each node
    estimators = {
        c: RandomForestClassifier(
            featuresCol=train.FEATURES, labelCol=c, numTrees=trees, maxDepth=depth, subsamplingRate=0.8, seed=42, maxMemoryInMB=memory
        )
        for c in "ab"
    }
    blocks = forest.pack(rows, train.FEATURES, ["a", "b"], estimators["a"])
    for label, estimator in estimators.items():
        found = forest.fit_forest(blocks, label, estimator)
        want = estimator.fit(rows)
        assert stored(spark, found, str(tmp_path / "found")) == stored(spark, want, str(tmp_path / "want"))
        assert found.totalNumNodes == want.totalNumNodes > trees
        assert found.numFeatures == width and found.getNumTrees == trees
    blocks.close()
    rows.unpersist()


def test_random_numbers_are_those_of_the_jvm(spark):
    jvm = spark._jvm
    random = jvm.java.util.Random(7)
    want = [random.nextLong() for _ in range(9)]
    assert forest.next_longs(7, 0, 9).astype(np.int64).tolist() == want
    assert forest.next_longs(7, 6, 3).astype(np.int64).tolist() == want[6:]
    seeds = forest.next_longs(7, 0, 2)
    for seed, found in zip(seeds.astype(np.int64).tolist(), forest.reservoirs(seeds, 200, 15).tolist()):
        random, kept = jvm.org.apache.spark.util.random.XORShiftRandom(seed), list(range(15))
        for item in range(15, 200):
            at = int(random.nextDouble() * (item + 1))
            if at < 15:
                kept[at] = item
        assert found == kept
    for seed, mean in ((43, 0.8), (-5, 1.0)):
        poisson = jvm.org.apache.commons.math3.distribution.PoissonDistribution(mean)
        poisson.reseedRandomGenerator(seed)
        assert forest.poisson_counts(seed, mean, 2_500).tolist() == [poisson.sample() for _ in range(2_500)]


def test_thresholds_of_a_feature():
    few = forest.feature_thresholds(np.array([1.0, 2.0]), np.array([3, 1]), 10.0, 31)
    assert few.tolist() == [0.5, 1.5]
    assert forest.feature_thresholds(np.array([1.0]), np.array([10]), 10.0, 31).tolist() == []
    many = forest.feature_thresholds(np.arange(1.0, 101.0), np.ones(100, np.int64), 100.0, 3)
    assert many.tolist() == [25.5, 50.5, 75.5]


def test_a_family_packs_its_rows_once(spark, monkeypatch):
    df = sparse_rows(spark, 60, 30, 2).withColumn("example_id", F.monotonically_increasing_id())
    df = df.withColumn("c", F.lit(1.0))
    packed, real = [], forest.pack
    monkeypatch.setattr(forest, "pack", lambda *a: packed.append(a[2]) or real(*a))
    params = TrainParams(rf_trees=3, rf_depth=3)
    fitted = fit_family(df, ["a", "b", "c"], "random_forest", params)
    assert packed == [["a", "b"]] and set(fitted.models) == {"a", "b"} and fitted.constants == {"c": 1.0}
    assert [m.getNumTrees for m in fitted.models.values()] == [3, 3]
    wide = fit_family(df.withColumn("a", 2 * F.col("a")), ["a"], "random_forest", params)
    assert len(packed) == 1 and wide.models["a"].numClasses == 3
