from __future__ import annotations

import pytest

from labelweave.functions.keys import with_example_id
from labelweave.operators import annotate
from labelweave.taxonomy import FINE_LABELS, Taxonomy

TAXONOMY = Taxonomy()


def test_unclear_flags(spark):
    rows = [(1, "True"), (2, None), (3, "0"), (4, " YES "), (5, "1"), (6, "False")]
    df = spark.createDataFrame(rows, "id int, example_very_unclear string")
    kept = annotate.filter_unclear(df)
    assert kept.columns == ["id"]
    assert sorted(r.id for r in kept.collect()) == [3, 6]
    assert annotate.filter_unclear(kept) is kept


def test_cast_labels_is_lenient_unless_strict(spark):
    df = spark.createDataFrame([("1", "x")], "a string, b string")
    row = annotate.cast_labels(df, ["a", "b"]).first()
    assert (row.a, row.b) == (1.0, None)
    with pytest.raises(Exception):
        annotate.cast_labels(df, ["a", "b"], strict=True).collect()


def test_raters_collapse_by_maximum(spark):
    rows = [(1, "t", 0.0, None), (1, "t", 1.0, 0.0), (1, "u", 0.0, None), (2, "t", 0.0, 1.0)]
    df = spark.createDataFrame(rows, "id int, text string, a double, b double")
    got = {(r.id, r.text): (r.a, r.b) for r in annotate.collapse_raters(df, ["a", "b"]).collect()}
    assert got == {(1, "t"): (1.0, 0.0), (1, "u"): (0.0, None), (2, "t"): (0.0, 1.0)}
    by_text = annotate.collapse_raters(df.drop("id"), ["a"]).collect()
    assert {r.text: r.a for r in by_text} == {"t": 1.0, "u": 0.0}
    with pytest.raises(ValueError):
        annotate.collapse_raters(df.select("a"), ["a"])


def test_taxonomy_projection_nulls_and_missing_sources(spark):
    values = {"fear": None, "nervousness": None, "desire": None, "curiosity": 1.0}
    columns = ", ".join(f"{c} double" for c in values)
    df = spark.createDataFrame([tuple(values.values())], columns)
    row = annotate.project_taxonomy(df, TAXONOMY, []).first().asDict()
    assert row.pop("anticipation") == 1.0
    assert set(row.values()) == {0.0}
    assert list(annotate.project_taxonomy(df, TAXONOMY, []).columns) == TAXONOMY.labels


def test_primary_label(spark):
    df = spark.createDataFrame([(0.0, 1.0, 1.0), (0.0, 0.0, None)], "joy double, trust double, anger double")
    got = [r[0] for r in df.select(annotate.primary_label(["joy", "trust", "anger"])).collect()]
    assert got == ["trust", "neutral"]


def test_example_id_digest_tells_parts_apart(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "c"), ("", "c")], "id string, text string")
    ids = [r.example_id for r in with_example_id(df, ["id", "text"]).collect()]
    assert len(set(ids)) == 4
    assert with_example_id(df, ["id"]).first().example_id == "ab"


def test_prepare_examples_drops_null_texts_and_samples_by_key(spark):
    labels = ", ".join(f"{c} string" for c in FINE_LABELS)
    zero = tuple("0" for _ in FINE_LABELS)
    rows = [(str(i), f"text {i}", "False", *zero) for i in range(200)] + [("x", None, "False", *zero)]
    df = spark.createDataFrame(rows, f"id string, text string, example_very_unclear string, {labels}")
    full = annotate.prepare_examples(df, TAXONOMY)
    assert full.columns == ["example_id", "text", *TAXONOMY.labels]
    assert full.count() == 200
    part = annotate.prepare_examples(df, TAXONOMY, sample_fraction=0.3)
    again = annotate.prepare_examples(df.repartition(7), TAXONOMY, sample_fraction=0.3)
    keys = {r.example_id for r in part.collect()}
    assert 30 < len(keys) < 90
    assert keys == {r.example_id for r in again.collect()}
