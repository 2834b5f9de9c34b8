from __future__ import annotations

import hashlib

import pytest

from labelweave.functions.keys import hex_cut
from labelweave.operators import split


def brute_force(rows, seed=42, ratios=(0.7, 0.15)):
    """Split by sorting each stratum in memory."""
    groups = {}
    for key, stratum in rows:
        groups.setdefault(stratum, []).append(key)
    result = {}
    for members in groups.values():
        members.sort(key=lambda k: (hashlib.md5(f"{seed}:{k}".encode()).hexdigest(), k))
        divisor = max(len(members) - 1, 1)
        for place, key in enumerate(members):
            rank = place / divisor
            result[key] = (
                rank,
                "train" if rank <= ratios[0] else "validation" if rank <= ratios[0] + ratios[1] else "test",
            )
    return result


# One stratum holds most rows; others have one, two and three.
ROWS = (
    [(i, "hot") for i in range(3000)]
    + [(10_000, "single")]
    + [(20_000 + i, "pair") for i in range(2)]
    + [(30_000 + i, "three") for i in range(3)]
    + [(40_000 + i, None) for i in range(50)]
)


@pytest.mark.parametrize("digits", [1, 2, 4])
@pytest.mark.parametrize("partitions", [1, 32])
def test_cut_split_equals_sorting(spark, digits, partitions):
    df = spark.createDataFrame(ROWS, "k long, s string").repartition(partitions)
    got = split.stratified_split(df, "k", "s", digits=digits).collect()
    want = brute_force(ROWS)
    assert len(got) == len(ROWS)
    assert {r.k: r.split for r in got} == {k: part for k, (_, part) in want.items()}


def test_bucketed_ranks_equal_sorting(spark):
    df = spark.createDataFrame(ROWS, "k long, s string")
    got = {r.k: r["rank"] for r in split.percent_ranks(df, "k", "s", digits=2).collect()}
    assert got == {k: rank for k, (rank, _) in brute_force(ROWS).items()}


@pytest.mark.parametrize(("digits", "max_rows"), [(1, 5), (1, 1), (3, 2), (32, 1)])
def test_lengthened_prefixes_give_the_same_split(spark, digits, max_rows):
    df = spark.createDataFrame(ROWS, "k long, s string")
    got = split.stratified_split(df, "k", "s", digits=digits, max_rows=max_rows).collect()
    assert {r.k: r.split for r in got} == {k: part for k, (_, part) in brute_force(ROWS).items()}
    ranks = split.percent_ranks(df, "k", "s", digits=1, max_rows=max_rows).collect()
    assert {r.k: r["rank"] for r in ranks} == {k: rank for k, (rank, _) in brute_force(ROWS).items()}


def test_a_large_stratum_is_ranked_in_small_parts(spark):
    df = spark.range(1_000_000).selectExpr("id AS k", "'all' AS s")
    keyed = split._keyed(df, "k", "s", 42, 1)
    opens = lambda a, b: (a <= 0.7) != (b <= 0.7)
    levels = split.refined_spans(keyed, opens, 1, 1_000)
    assert [digits for digits, _, _ in levels] == [1, 4]
    rows = [r for _, _, opened in levels for r in opened.collect()]
    assert rows and max(r["_last"] - r["_first"] + 1 for r in rows) <= 1_000
    # All ranks are there once: closed and open spans follow each other without a gap.
    spans = sorted((r["_first"], r["_last"]) for _, closed, opened in levels for r in closed.collect() + opened.collect())
    assert spans[0][0] == 0 and spans[-1][1] == 999_999 and all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:]))
    counts = {r.split: r.rows for r in split.split_counts(split.stratified_split(df, "k", "s", digits=1, max_rows=1_000)).collect()}
    assert counts == {"train": 700_000, "validation": 150_000, "test": 150_000}


def test_a_key_that_many_rows_share_is_one_place(spark):
    rows = [(7, "s")] * 400 + [(i, "s") for i in range(1_000, 1_600)]
    df = spark.createDataFrame(rows, "k long, s string")
    plain = {(r.k, r.split) for r in split.stratified_split(df, "k", "s").collect()}
    fine = {(r.k, r.split) for r in split.stratified_split(df, "k", "s", digits=1, max_rows=3).collect()}
    assert plain == fine and len({part for k, part in plain if k == 7}) == 1


def test_small_strata(spark):
    df = spark.createDataFrame(ROWS, "k long, s string")
    parts = {r.k: r.split for r in split.stratified_split(df, "k", "s").filter("s != 'hot'").collect()}
    assert parts[10_000] == "train"
    assert sorted(parts[30_000 + i] for i in range(3)) == ["test", "train", "train"]


def test_wide_rows_are_not_shuffled(spark):
    df = spark.range(1000).selectExpr("id AS k", "cast(id % 3 AS string) AS s", "'wide' AS text")
    plan = split.stratified_split(df, "k", "s")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    assert "Window" not in plan and "Sort" not in plan


def test_hash_split_and_sample(spark):
    df = spark.range(4000).withColumnRenamed("id", "k")
    counts = {r.split: r.rows for r in split.split_counts(split.hash_split(df, "k")).collect()}
    assert sum(counts.values()) == 4000
    assert 2650 < counts["train"] < 2950 and 500 < counts["validation"] < 700
    assert 850 < split.hash_sample(df, "k", 0.25).count() < 1150
    assert split.hash_sample(df, "k", 1.0).count() == 4000
    assert split.hash_sample(df, "k", 0.0).count() == 0
    with pytest.raises(ValueError):
        hex_cut(1.5)


def test_sample_rows_do_not_depend_on_order(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    first = [r.k for r in split.sample_rows(df, "k", 15).collect()]
    again = [r.k for r in split.sample_rows(df.repartition(9), "k", 15).collect()]
    assert first == again and len(first) == 15


def test_partition_targets(spark):
    df = spark.range(10, numPartitions=2)
    assert split.ensure_partitions(df, None) is df
    assert split.ensure_partitions(df, 5).rdd.getNumPartitions() == 5
    assert split.spread(df, "id", 8).rdd.getNumPartitions() == 8
    assert split.spread(df, "id", None) is df
