from __future__ import annotations

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from labelweave.functions import narrative
from labelweave.operators import metrics, scores, thresholds
from labelweave.operators.scores import SCORES_SCHEMA
from labelweave.taxonomy import DESCRIPTORS


def table(spark, rows):
    """Score rows, whose last field ``raw`` may be left out."""
    return spark.createDataFrame([(*r, None) if len(r) == 8 else r for r in rows], SCORES_SCHEMA)


def votes(spark, *cells):
    rows = [
        (1, "test", f"m{i}", "joy", 0, 1.0, score, pred) for i, (score, pred) in enumerate(cells)
    ]
    return scores.majority_vote(table(spark, rows)).collect()


def test_vote_averages_scores_and_predictions(spark):
    (row,) = votes(spark, (0.9, 1.0), (0.2, 0.0), (None, 1.0))
    assert row.score == pytest.approx(0.7) and row.pred == 1.0 and row.model == "majority_vote"
    (edge,) = votes(spark, (0.25, 0.0), (0.75, 1.0))
    assert (edge.score, edge.pred) == (0.5, 1.0)
    with pytest.raises(ValueError):
        votes(spark, (0.9, 1.0))


def test_only_examples_of_all_models_are_joined(spark):
    rows = [(1, "test", "a", "joy", 0, 1.0, 0.5, 1.0), (1, "test", "b", "joy", 0, 1.0, 0.7, 1.0),
            (2, "test", "a", "joy", 0, 1.0, 0.5, 1.0)]
    joined = scores.prediction_join(table(spark, rows)).collect()
    assert [(r.example_id, r.score_a, r.score_b) for r in joined] == [(1, 0.5, 0.7)]
    with pytest.raises(ValueError):
        scores.prediction_join(table(spark, rows).drop("example_id"), ["a", "b"])


def test_scores_without_keys_are_joined_by_text(spark):
    rows = [(t, "test", m, "joy", 0, 1.0, v, 1.0) for t, m, v in
            [("x", "a", 0.5), ("x", "b", 0.7), ("y", "a", 0.5), (None, "a", 0.1), (None, "b", 0.2)]]
    schema = SCORES_SCHEMA.replace("example_id long", "text string").replace(", raw double", "")
    joined = scores.prediction_join(spark.createDataFrame(rows, schema)).collect()
    assert [(r.text_digest, r.score_a, r.score_b) for r in joined] == [("9dd4e461268c8034f5c8564e155c67a6", 0.5, 0.7)]
    (vote,) = scores.majority_vote(spark.createDataFrame(rows, schema)).collect()
    assert vote.score == pytest.approx(0.6) and vote.text_digest == joined[0].text_digest
    with pytest.raises(ValueError, match="more than once"):
        scores.prediction_join(spark.createDataFrame([*rows, rows[0]], schema))


def test_positive_score(spark):
    df = spark.createDataFrame([(Vectors.dense([0.2, 0.8]), Vectors.dense([1.0]), 0.3)], ["two", "one", "plain"])
    row = df.select(
        scores.positive_score(df, "two"), scores.positive_score(df, "one"),
        scores.positive_score(df, "one", last=True), scores.positive_score(df, "plain"),
    ).first()
    assert tuple(row) == (0.8, None, 1.0, 0.3)
    with pytest.raises(ValueError):
        scores.positive_score(df, "none")


def test_canonical_predictions(spark):
    rows = [(1, "test", "a", "joy", 0, 1.0, 0.55, 0.0), (2, "test", "a", "joy", 0, 0.0, 0.54, 1.0),
            (3, "test", "a", "fear", 1, 0.0, 0.5, 0.0), (4, "test", "svm", "joy", 0, 0.0, None, 1.0)]
    limits = spark.createDataFrame([("a", "joy", 0.55)], "model string, label string, threshold double")
    got = {r.example_id: (r.pred, r.threshold) for r in scores.canonical_predictions(table(spark, rows), limits).collect()}
    assert got == {1: (1.0, 0.55), 2: (0.0, 0.55), 3: (1.0, 0.5), 4: (1.0, 0.5)}


def test_threshold_grid_equals_counting(spark):
    cells = [((i * 37 % 101) / 100.0, float(i % 3 == 0)) for i in range(300)]
    rows = [(i, "validation", "a", "joy", 0, y, s, 0.0) for i, (s, y) in enumerate(cells)]
    rows.append((999, "validation", "svm", "joy", 0, 1.0, None, 1.0))
    candidates = [0.7, 0.3, 0.5, 0.3, 1.7, 0.0, 1.0]
    got = {r.threshold: r for r in thresholds.threshold_grid(table(spark, rows), candidates).collect()}
    assert sorted(got) == [0.0, 0.3, 0.5, 0.7, 1.0]
    for limit, r in got.items():
        assert r.model == "a"
        assert r.tp == sum(s >= limit and y == 1.0 for s, y in cells)
        assert r.fp == sum(s >= limit and y == 0.0 for s, y in cells)
        assert r.fn == sum(s < limit and y == 1.0 for s, y in cells)
    with pytest.raises(ValueError):
        thresholds.threshold_grid(table(spark, rows), [1.5])


def test_best_threshold_ties(spark):
    schema = "model string, label string, threshold double, f1 double, recall double"
    rows = [("a", "x", 0.3, 0.5, 0.5), ("a", "x", 0.5, 0.5, 0.5),
            ("a", "y", 0.3, 0.5, 0.4), ("a", "y", 0.6, 0.5, 0.6), ("a", "z", 0.3, 0.1, 0.9), ("a", "z", 0.7, 0.2, 0.1)]
    best = thresholds.best_thresholds(spark.createDataFrame(rows, schema)).collect()
    assert {r.label: r.threshold for r in best} == {"x": 0.3, "y": 0.6, "z": 0.7}


def test_tuning_keeps_configured_values_without_scores(spark):
    rows = [(1, "validation", "svm", "joy", 0, 1.0, None, 1.0), (1, "validation", "svm", "other", 1, 1.0, None, 1.0),
            (1, "validation", "a", "joy", 0, 1.0, 0.65, 1.0), (2, "validation", "a", "joy", 0, 0.0, 0.4, 1.0)]
    configured = {"joy": 0.55}
    tuned = thresholds.tune_thresholds(table(spark, rows), [0.3, 0.5, 0.6], configured)
    assert {(r.model, r.label): r.threshold for r in tuned.collect()} == {
        ("svm", "joy"): 0.55, ("svm", "other"): 0.5, ("a", "joy"): 0.5}
    kept = thresholds.tune_thresholds(table(spark, rows), [2.0], configured)
    assert {(r.model, r.label): r.threshold for r in kept.collect()}[("a", "joy")] == 0.55
    assert thresholds.tune_thresholds(table(spark, []), [0.5], configured).count() == 0


def test_threshold_precedence(spark):
    known = spark.createDataFrame([("fear", 0.45), ("joy", None)], "label string, threshold double")

    def resolved(**options):
        return {r.label: r.threshold for r in thresholds.resolve_thresholds(known, **options).collect()}

    assert resolved(base=0.6, overrides={"fear": 0.2, "nope": 0.1}) == {"fear": 0.2, "joy": 0.6}
    assert resolved(base=0.6) == {"fear": 0.6, "joy": 0.6}
    assert resolved() == {"fear": 0.45, "joy": 0.5}


def test_metrics(spark):
    y, p = [[1, 0], [1, 1]], [[1, 0], [0, 1]]
    rows = [
        (e, "test", "a", f"l{j}", j, float(y[e][j]), None, float(p[e][j])) for e in range(2) for j in range(2)
    ]
    summary, labels = metrics.evaluate(table(spark, rows))
    s = summary.first()
    assert (s.hamming_loss, s.subset_accuracy) == (0.25, 0.5)
    assert (s.micro_precision, s.micro_recall, s.micro_f1) == pytest.approx((1, 2 / 3, 0.8))
    assert s.macro_f1 == pytest.approx(5 / 6)
    by_label = {r.label: r for r in labels.collect()}
    assert (by_label["l0"].precision, by_label["l0"].recall, by_label["l0"].support) == (1.0, 0.5, 2)
    assert by_label["l0"].f1 == pytest.approx(2 / 3)
    assert by_label["l1"].f1 == 1.0


def test_metrics_of_an_absent_label(spark):
    rows = [(1, "test", "a", "x", 0, 0.0, 0.1, 0.0), (1, "test", "a", "y", 1, 1.0, 0.9, 1.0)]
    summary, labels = metrics.evaluate(table(spark, rows))
    absent = labels.filter("label = 'x'").first()
    assert (absent.precision, absent.recall, absent.f1, absent.support) == (0.0, 0.0, 0.0, 0)
    assert summary.first().macro_f1 == 0.5


def told(spark, cells, limit=0.5):
    labels = list(DESCRIPTORS)
    rows = [
        (1, "test", "a", labels[i], i, 0.0, score, pred) for i, (score, pred) in enumerate(cells)
    ]
    df = narrative.gather_labels(table(spark, rows).withColumn("threshold", F.lit(limit)), "example_id")
    results = F.col("predictions")
    return df.select(
        narrative.positive_labels(results), narrative.top_labels(results, 3), narrative.story(results, DESCRIPTORS)
    ).first()


def test_stories(spark):
    two = told(spark, [(0.625, 1.0), (0.5, 1.0), (0.875, 1.0), (0.1, 0.0)])
    assert two[0] == ["joy", "trust", "fear"] and two[1] == ["fear", "joy", "trust"]
    assert two[2] == (
        "Undercurrents of fear lead the narrative (88%), with a uplifting undertone from joy (62%)."
    )
    single = told(spark, [(0.9, 1.0), (0.2, 1.0)])
    assert single[2] == "Bright bursts of joy set a uplifting tone at 90%."
    muted = told(spark, [(None, 0.0), (None, 1.0)])
    assert muted[0] == ["trust"] and muted[1] == ["trust"]
    assert muted[2] == "Steady notes of trust emerge despite muted probability scores."
    nothing = told(spark, [(0.1, 0.0), (0.2, 1.0)])
    assert nothing[0] == [] and nothing[1] == ["trust", "joy"]
    assert nothing[2] == "Emotional signals stay below all configured thresholds."


def test_score_ties_keep_label_order(spark):
    assert told(spark, [(0.6, 1.0), (0.6, 1.0), (0.6, 1.0)])[1] == ["joy", "trust", "fear"]


def test_unknown_labels_describe_themselves(spark):
    df = table(spark, [(1, "t", "a", "odd label", 0, 0.0, 0.9, 1.0)]).withColumn("threshold", F.lit(0.5))
    results = narrative.gather_labels(df, "example_id").select(narrative.story(F.col("predictions"), DESCRIPTORS))
    assert results.first()[0] == "Odd label set a odd label tone at 90%."


def test_wide_prediction_columns(spark):
    rows = [(1, "test", "a", "x", 0, 0.0, 0.1, 0.0), (1, "test", "a", "y", 1, 1.0, 0.9, 1.0)]
    row = scores.prediction_columns(table(spark, rows), ["x", "y"]).first()
    assert (row.x, row.pred_x, row.y, row.pred_y) == (0.0, 0.0, 1.0, 1.0)
