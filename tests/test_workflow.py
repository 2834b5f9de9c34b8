from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from labelweave.operators import train
from labelweave.operators.features import FeatureParams
from labelweave.operators.metrics import evaluate
from labelweave.operators.scores import canonical_predictions
from labelweave.operators.train import TrainParams, fit_family, load_models, save_models, score_rows
from labelweave.plans import workflow
from labelweave.plans.scoring import ScoringBundle, score_table
from labelweave.plans.workflow import WorkflowParams, run_workflow
from labelweave.sources import annotations, artifacts
from labelweave.taxonomy import LEXICON_EMOTIONS

LABELS = ["quality", "toxic", "never"]
FAST = WorkflowParams(
    features=FeatureParams(max_vocab=80, min_df=3),
    training=TrainParams(lr_max_iter=8, svm_max_iter=8, rf_trees=5, rf_depth=3),
    sample_size=4,
)


@pytest.fixture(scope="module")
def inputs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet")
    examples = docs.join(marks, "doc_id").selectExpr(
        "doc_id AS example_id", "text", "double(quality) AS quality", "double(toxic) AS toxic", "0.0D AS never"
    )
    pairs = spark.createDataFrame([("this", "joy"), ("ened", "fear")], "term string, emotion string")
    vad = spark.createDataFrame([("ened", 0.5, 0.25, 0.5)], "term string, valence double, arousal double, dominance double")
    return examples, {"pairs": pairs, "vad": vad, "emotions": LEXICON_EMOTIONS}


@pytest.fixture(scope="module")
def finished(spark, inputs, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("run"))
    examples, lexica = inputs
    return run_workflow(spark, examples, LABELS, out, params=FAST, **lexica)


def test_splits_are_disjoint_and_complete(spark, inputs, finished):
    rows = spark.read.parquet(f"{finished.out}/features").select("example_id", "split").collect()
    assert len(rows) == len({r.example_id for r in rows}) == inputs[0].count()
    counts = {r.split: r.rows for r in finished.counts.collect()}
    assert sum(counts.values()) == len(rows) and counts["train"] > counts["test"] > 0


def test_scores_of_all_families(finished):
    rows = finished.scores.collect()
    assert {r.model for r in rows} == {*train.FAMILIES, "majority_vote"}
    assert {r.split for r in rows} == {"train", "validation", "test"}
    for r in rows:
        assert r.pred in (0.0, 1.0)
        if r.model == "linear_svm":
            assert r.score is None and (r.raw is None) == (r.label == "never")
            assert r.raw is None or (r.raw > 0) == (r.pred == 1.0)
        else:
            assert 0.0 <= r.score <= 1.0
    cells = {}
    for r in rows:
        if r.model != "majority_vote":
            cells.setdefault((r.example_id, r.label), []).append(r.pred if r.score is None else r.score)
    for r in rows:
        if r.model == "majority_vote":
            votes = cells[(r.example_id, r.label)]
            assert min(votes) - 1e-12 <= r.score <= max(votes) + 1e-12


def test_a_label_never_seen_is_never_positive(finished):
    never = finished.scores.filter("label = 'never'")
    assert never.filter("pred > 0 OR score > 0").count() == 0


def test_tuned_f1_is_at_least_that_of_one_half(spark, finished):
    scores = finished.scores.filter("split = 'validation' AND score IS NOT NULL")
    half = finished.thresholds.withColumn("threshold", F.lit(0.5))

    def f1(limits):
        _, labels = evaluate(canonical_predictions(scores, limits))
        return {(r.model, r.label): r.f1 for r in labels.collect()}

    tuned, plain = f1(finished.thresholds), f1(half)
    assert all(tuned[key] >= plain[key] for key in plain)


def test_summary_follows_from_the_confusion_rows(finished):
    counts = {}
    for r in finished.per_label.collect():
        tp, fp, fn = counts.get((r.model, r.split), (0, 0, 0))
        counts[(r.model, r.split)] = (tp + r.tp, fp + r.fp, fn + r.fn)
    for r in finished.summary.collect():
        tp, fp, fn = counts[(r.model, r.split)]
        assert r.micro_precision == pytest.approx(tp / (tp + fp) if tp + fp else 0.0)
        assert r.micro_recall == pytest.approx(tp / (tp + fn) if tp + fn else 0.0)


def test_written_tables(spark, finished):
    report = spark.read.json(f"{finished.out}/metrics")
    assert {r.dataset for r in report.select("dataset").collect()} == {"train", "validation", "test"}
    first = report.first()
    assert [e.label for e in first.per_label] == LABELS
    samples = spark.read.json(finished.samples)
    assert samples.count() == 4 and {"text", "quality", "toxic"} <= set(samples.columns)
    assert artifacts.read_sample_texts(spark, finished.samples).columns == ["text"]
    holdout = spark.read.parquet(f"{finished.out}/holdout")
    assert holdout.count() == {r.split: r.rows for r in finished.counts.collect()}["test"]
    stored = spark.read.parquet(f"{finished.out}/features")
    assert "text" not in stored.columns and "label_array" in stored.columns


def test_second_run_resumes(spark, inputs, finished):
    examples, lexica = inputs
    again = run_workflow(spark, examples, LABELS, finished.out, params=FAST, **lexica)
    assert again.resumed == ["features", *train.FAMILIES]
    want = sorted(finished.summary.collect())
    assert sorted(again.summary.collect()) == want


def test_other_parameters_start_over(spark, inputs, tmp_path):
    examples, lexica = inputs
    one = replace(FAST, families=("naive_bayes",), sample_size=0, include_train=False, stratify=False, buckets=3)
    first = run_workflow(spark, examples, LABELS, str(tmp_path), params=one, **lexica)
    assert first.skipped == ["majority_vote"] and first.samples is None
    assert {r.split for r in first.scores.select("split").distinct().collect()} == {"validation", "test"}
    more = replace(one, families=("naive_bayes", "logistic_regression"), land=True, sample_size=2)
    second = run_workflow(spark, examples, LABELS, str(tmp_path), params=more, **lexica)
    assert second.resumed == ["features", "naive_bayes"]
    assert {r.model for r in second.scores.select("model").distinct().collect()} == {
        "naive_bayes", "logistic_regression", "majority_vote"}
    changed = replace(more, families=("naive_bayes",), features=FeatureParams(max_vocab=20, min_df=3), land=False,
                      save_features=False, auto_tune=False, thresholds={"toxic": 0.3})
    third = run_workflow(spark, examples, LABELS, str(tmp_path), params=changed, **lexica)
    assert third.resumed == []
    assert artifacts.models_present(spark, f"{tmp_path}/scores") == {"naive_bayes"}
    assert {r.label: r.threshold for r in third.thresholds.collect()} == {"quality": 0.5, "toxic": 0.3, "never": 0.5}


def run_bayes(spark, inputs, out, examples=None, **changes):
    params = replace(FAST, families=("naive_bayes",), sample_size=0, **changes)
    return run_workflow(spark, inputs[0] if examples is None else examples, LABELS, str(out), params=params, **inputs[1])


def test_train_scores_are_added_later(spark, inputs, tmp_path):
    run_bayes(spark, inputs, tmp_path, include_train=False)
    again = run_bayes(spark, inputs, tmp_path)
    assert again.resumed == ["features", "naive_bayes"]
    assert {r.split for r in again.scores.select("split").distinct().collect()} == {"train", "validation", "test"}
    fresh = run_bayes(spark, inputs, f"{tmp_path}/fresh")
    assert sorted(again.scores.collect()) == sorted(fresh.scores.collect())


def test_other_rows_start_over(spark, inputs, tmp_path):
    first = run_bayes(spark, inputs, tmp_path, inputs[0].filter("example_id % 2 = 0"))
    fewer = first.counts.agg(F.sum("rows")).first()[0]
    again = run_bayes(spark, inputs, tmp_path)
    assert first.resumed == again.resumed == []
    scored = again.scores.select("example_id").distinct().count()
    assert scored == inputs[0].count() > fewer


def test_unsaved_features_are_not_resumed(spark, inputs, tmp_path):
    run_bayes(spark, inputs, tmp_path)
    run_bayes(spark, inputs, tmp_path, features=FeatureParams(max_vocab=20, min_df=3), save_features=False)
    again = run_bayes(spark, inputs, tmp_path, features=FeatureParams(max_vocab=20, min_df=3))
    assert again.resumed == []
    again = run_bayes(spark, inputs, tmp_path, features=FeatureParams(max_vocab=20, min_df=3))
    assert again.resumed == ["features", "naive_bayes"]


def test_no_split_of_an_earlier_run_stays(spark, inputs, tmp_path):
    run_bayes(spark, inputs, tmp_path)
    configured = {"toxic": 0.3}
    again = run_bayes(spark, inputs, tmp_path, ratios=(0.8, 0.0, 0.2), thresholds=configured)
    rows = spark.read.parquet(f"{tmp_path}/features").select("example_id", "split").collect()
    assert len(rows) == inputs[0].count() and {r.split for r in rows} == {"train", "test"}
    # Without validation rows the configured thresholds hold.
    assert {r.label: r.threshold for r in again.thresholds.collect()} == {"quality": 0.5, "toxic": 0.3, "never": 0.5}


def test_a_killed_run_goes_on_where_it_ended(spark, inputs, finished, tmp_path, monkeypatch):
    examples, lexica = inputs
    params = replace(FAST, families=("naive_bayes", "linear_svm"), sample_size=0)
    real = workflow.fit_family

    def dies(rows, labels, family, training):
        if family == "linear_svm":
            raise RuntimeError("killed")
        return real(rows, labels, family, training)

    monkeypatch.setattr(workflow, "fit_family", dies)
    with pytest.raises(RuntimeError):
        run_workflow(spark, examples, LABELS, str(tmp_path), params=params, **lexica)
    monkeypatch.setattr(workflow, "fit_family", real)
    again = run_workflow(spark, examples, LABELS, str(tmp_path), params=params, **lexica)
    assert again.resumed == ["features", "naive_bayes"]
    same = F.col("model").isin("naive_bayes", "linear_svm")
    assert sorted(again.scores.filter(same).collect(), key=str) == sorted(finished.scores.filter(same).collect(), key=str)


def test_a_run_killed_before_its_scores_keeps_its_models(spark, inputs, tmp_path, monkeypatch):
    real = workflow.score_rows
    monkeypatch.setattr(workflow, "score_rows", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        run_bayes(spark, inputs, tmp_path)
    monkeypatch.setattr(workflow, "score_rows", real)
    monkeypatch.setattr(workflow, "fit_family", None)
    again = run_bayes(spark, inputs, tmp_path)
    assert again.resumed == ["features", "naive_bayes"] and again.scores.count() == 3 * inputs[0].count()


def test_a_changed_setting_fits_its_own_family_only(spark, inputs, tmp_path, monkeypatch):
    examples, lexica = inputs
    params = replace(FAST, families=("naive_bayes", "linear_svm"), sample_size=0)
    first = run_workflow(spark, examples, LABELS, str(tmp_path), params=params, **lexica)
    old = {(r.example_id, r.model, r.label): (r.score, r.raw) for r in first.scores.collect()}
    fitted = []
    real = workflow.fit_family
    monkeypatch.setattr(workflow, "fit_family", lambda *a: fitted.append(a[2]) or real(*a))
    changed = replace(params, training=replace(FAST.training, svm_reg=10.0))
    again = run_workflow(spark, examples, LABELS, str(tmp_path), params=changed, **lexica)
    assert fitted == ["linear_svm"] and again.resumed == ["features", "naive_bayes"]
    new = {(r.example_id, r.model, r.label): (r.score, r.raw) for r in again.scores.collect()}
    assert set(new) == set(old)
    assert {k for k in new if new[k] != old[k] and k[1] != "majority_vote"} <= {k for k in new if k[1] == "linear_svm"}
    assert any(new[k] != old[k] for k in new if k[1] == "linear_svm")


@pytest.mark.parametrize("buckets", [None, 3])
def test_the_input_is_computed_once(spark, inputs, tmp_path, buckets):
    met = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        met.add(1)
        return text

    given = inputs[0].withColumn("text", counted.asNondeterministic()("text"))
    rows = inputs[0].count()
    run_bayes(spark, inputs, tmp_path, given, buckets=buckets)
    assert met.value == rows
    if buckets:
        return
    again = run_bayes(spark, inputs, tmp_path, given, buckets=buckets)
    assert met.value == 2 * rows and again.resumed == ["features", "naive_bayes"]


def test_missing_values_change_the_digest(spark):
    digest = lambda *row: artifacts.content_digest(spark.createDataFrame([row], "a string, b string"))
    assert len({str(digest(*row)) for row in [("x", None), (None, "x"), ("x", "x"), (None, None)]}) == 4
    table = spark.createDataFrame([(1, "x", None), (2, None, "x")], "example_id long, a string, b string")
    assert artifacts.keyed_digest(table, "example_id") == artifacts.content_digest(table)


def test_keys_must_be_unique(spark, inputs, tmp_path):
    twice = inputs[0].unionByName(inputs[0].limit(1))
    missing = inputs[0].withColumn("example_id", F.when(F.col("example_id") > 5, F.col("example_id")))
    for bad in (twice, missing):
        with pytest.raises(ValueError):
            run_bayes(spark, inputs, tmp_path, bad)


def keyed(spark, n):
    rows = [(i, "train", *[Vectors.dense([float(i % 7), float(i % 3), 1.0])] * 2, float(i % 7 > i % 3)) for i in range(n)]
    return spark.createDataFrame(rows, ["example_id", "split", train.FEATURES, train.COUNTS, "a"])


@pytest.mark.parametrize("family", train.FAMILIES)
def test_fits_do_not_depend_on_the_layout(spark, family):
    df = keyed(spark, 90)
    params = TrainParams(rf_trees=7, rf_depth=4, rows_per_partition=25)
    found = []
    for layout in (df.coalesce(1), df.repartition(4), df.orderBy(F.desc("example_id")).repartition(32)):
        fitted = fit_family(layout, ["a"], family, params)
        found.append({r.example_id: (r.score, r.raw) for r in score_rows(df, fitted).collect()})
    assert found[0] == found[1] == found[2]


def test_partitions_follow_the_rows(spark):
    for n in (1, 90, 400):
        dealt = train.dealt_by_key(keyed(spark, n), "example_id", 25)
        sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
        assert dealt.rdd.getNumPartitions() == -(-n // 25) and sum(sizes) == n and max(sizes) < 60
    assert train.dealt_by_key(keyed(spark, 90).limit(0), "example_id", 25).count() == 0


def test_a_forest_depends_on_its_rows_only(spark):
    df = keyed(spark, 200)
    found = []
    for size in (10, 50):
        fitted = fit_family(df, ["a"], "random_forest", TrainParams(rf_trees=9, rf_depth=4, rows_per_partition=size))
        found.append({r.example_id: r.score for r in score_rows(df, fitted).collect()})
    assert found[0] == found[1] and len(set(found[0].values())) > 1


@pytest.mark.parametrize("family", train.LINEAR)
def test_one_matrix_gives_the_outputs_of_all_label_models(spark, family):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(120):
        x = rng.poisson(1.0, 12).astype(float)
        v = Vectors.sparse(12, [(j, a) for j, a in enumerate(x) if a])
        rows.append((i, "train", v, v, float(x[0] + x[1] > 2), 1.0, float(x[3] > x[4]), float(rng.random() < 0.1)))
    df = spark.createDataFrame(rows, ["example_id", "split", train.FEATURES, train.COUNTS, "a", "always", "b", "c"])
    fitted = fit_family(df, ["a", "always", "b", "c"], family)
    scored = score_rows(df, fitted)
    assert scored._jdf.queryExecution().executedPlan().toString().count("margins") >= 1
    applied, columns = train._stage_outputs(df, fitted)
    assert set(columns) == {"a", "b", "c"}
    wide = applied.select("example_id", *[x.alias(f"{c}{i}") for c, xs in columns.items() for i, x in enumerate(xs)])
    want = {r.example_id: r for r in wide.collect()}
    for r in scored.collect():
        if r.label == "always":
            assert (r.score, r.pred, r.raw) == (None if family == "linear_svm" else 1.0, 1.0, None)
            continue
        score, pred, raw = (want[r.example_id][f"{r.label}{i}"] for i in range(3))
        assert r.pred == pred and r.raw == pytest.approx(raw, abs=1e-9)
        assert r.score is None and score is None or r.score == pytest.approx(score, abs=1e-9)


def test_a_linear_family_is_one_stage(spark):
    df = keyed(spark, 40).withColumn("b", 1 - F.col("a"))
    fitted = fit_family(df, ["a", "b"], "linear_svm")
    applied, _ = train.label_outputs(df, fitted)
    assert set(applied.columns) - set(df.columns) == {"_margins_linear_svm"}


def test_unknown_family(spark, inputs, tmp_path):
    examples, lexica = inputs
    with pytest.raises(ValueError):
        run_workflow(spark, examples, LABELS, str(tmp_path), params=replace(FAST, families=("gbt",)), **lexica)


def test_scoring_new_texts(spark, inputs, finished):
    texts = annotations.text_table(spark, ["ened this this!", "", "zzz"])
    bundle = ScoringBundle.load(spark, finished.out)
    assert list(bundle.families) == train.FAMILIES
    rows = score_table(texts, bundle).orderBy("example_id").collect()
    assert len(rows) == 3
    saved = artifacts.read_thresholds(spark, f"{finished.out}/thresholds")
    limits = {r.label: r.threshold for r in saved.filter("model = 'majority_vote'").collect()}
    for r in rows:
        assert [p.label for p in r.predictions] == LABELS
        assert r.positive_labels == [p.label for p in r.predictions if p.score >= limits[p.label]]
        assert set(r.top_labels) == set(LABELS)
        assert r.story
    strict = score_table(texts, bundle, base_threshold=1.1, threshold_overrides={"toxic": 0.0}).collect()
    assert all(r.positive_labels == ["toxic"] for r in strict)
    svm = score_table(texts, bundle, model="linear_svm").first()
    assert all(p.score is None for p in svm.predictions)
    with pytest.raises(ValueError):
        score_table(texts, bundle, model="gbt")
    single = ScoringBundle.load(spark, finished.out, ["naive_bayes"])
    with pytest.raises(ValueError):
        score_table(texts, single)
    with pytest.raises(FileNotFoundError):
        ScoringBundle.load(spark, finished.out + "-none")


def test_scoring_agrees_with_training_scores(spark, inputs, finished):
    bundle = ScoringBundle.load(spark, finished.out)
    scored = score_table(inputs[0].select("example_id", "text"), bundle, model="logistic_regression")
    got = {
        (r.example_id, r.label): r.score
        for r in scored.select("example_id", F.inline("predictions")).collect()
    }
    rows = finished.scores.filter("model = 'logistic_regression'").collect()
    assert {(r.example_id, r.label): r.score for r in rows} == pytest.approx(got)


def vectors(spark, labels):
    rows = [(i, "train", Vectors.dense([float(y), 1.0]), Vectors.dense([float(y), 1.0]), float(y)) for i, y in enumerate(labels)]
    schema = ["example_id", "split", train.FEATURES, train.COUNTS, "a"]
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("family", train.FAMILIES)
def test_one_class_labels_are_not_fitted(spark, family, tmp_path):
    for value in (0, 1):
        df = vectors(spark, [value] * 4)
        fitted = fit_family(df, ["a"], family)
        assert fitted.models == {} and fitted.constants == {"a": float(value)}
        for r in score_rows(df, fitted).collect():
            assert r.pred == float(value)
            assert r.score == (None if family == "linear_svm" else float(value))
    save_models(fitted, str(tmp_path))
    assert load_models(spark, str(tmp_path), family).constants == {"a": 1.0}


def test_summaries_are_saved(spark, tmp_path):
    fitted = fit_family(vectors(spark, [0, 1, 0, 1]), ["a"], "logistic_regression")
    assert fitted.summaries["a"]["regParam"] == 0.1 and "objective" in fitted.summaries["a"]
    save_models(fitted, str(tmp_path))
    assert load_models(spark, str(tmp_path), "logistic_regression").summaries == fitted.summaries
    with pytest.raises(ValueError):
        load_models(spark, str(tmp_path), "gbt")
    with pytest.raises(ValueError):
        fit_family(vectors(spark, [0, 1]).limit(0), ["a"], "naive_bayes")


def test_csv_keeps_texts(spark, tmp_path):
    nasty = ['say "hi", ok', "two\nlines", "  blanks  ", 'tail\\', "a,b", "'"]
    df = spark.createDataFrame([(str(i), t, None) for i, t in enumerate(nasty)], "id string, text string, flag string")
    annotations.write_annotation_csv(df, str(tmp_path / "a"))
    annotations.write_annotation_csv(df.select("flag", "text", "id"), str(tmp_path / "b"))
    back = annotations.read_annotation_csv(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert sorted(r.text for r in back.collect()) == sorted(nasty * 2)
    assert back.filter("flag IS NOT NULL").count() == 0
    annotations.write_annotation_csv(df.drop("flag"), str(tmp_path / "c"))
    with pytest.raises(Exception):
        annotations.read_annotation_csv(spark, [str(tmp_path / "a"), str(tmp_path / "c")])
    with pytest.raises(ValueError):
        annotations.read_annotation_csv(spark, [])


def test_shards_with_many_headers_take_few_jobs(spark, tmp_path):
    (tmp_path / "with blank %20").mkdir()
    paths = []
    for i in range(12):
        path = tmp_path / "with blank %20" / f"shard {i}.csv"
        head, row = (("id,text,flag", f'{i},"a,\n{i}",x') if i % 2 else ("flag,id,text", f"x,{i},plain"))
        path.write_text(f"{head}\n{row}\n", encoding="utf-8")
        paths.append(str(path))
    odd = tmp_path / "odd.csv"
    odd.write_text('"id",text,"fl\nag"\n1,t,x\n', encoding="utf-8")
    groups = annotations.header_groups(spark, [*paths, str(odd)])
    assert sorted(map(len, groups)) == [1, 6, 6]
    back = annotations.read_annotation_csv(spark, paths).collect()
    assert sorted((int(r.id), r.text, r.flag) for r in back) == [(i, f"a,\n{i}" if i % 2 else "plain", "x") for i in range(12)]
    tracker = spark.sparkContext.statusTracker()
    counts = []
    for files in (paths[:2], paths):
        spark.sparkContext.setJobGroup(f"headers-{len(files)}", "headers")
        annotations.read_annotation_csv(spark, files)
        counts.append(len(tracker.getJobIdsForGroup(f"headers-{len(files)}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[0] == counts[1] > 0


def test_optional_reads(spark, tmp_path):
    assert artifacts.read_if_present(spark, str(tmp_path / "none")) is None
    assert artifacts.read_thresholds(spark, str(tmp_path / "none")) is None
    assert artifacts.read_scores(spark, str(tmp_path / "none")) is None
    assert artifacts.read_fingerprint(spark, str(tmp_path / "none")) is None
    assert artifacts.fingerprint(FAST) != artifacts.fingerprint(replace(FAST, seed=1))


def test_fits_do_not_carry_feature_names(spark, monkeypatch):
    names = [f"named_feature_{i}" for i in range(40)]
    plain = spark.createDataFrame([(i, float(i % 2), *[float(i % (k + 2)) for k in range(40)]) for i in range(60)], ["example_id", "a", *names])
    df = VectorAssembler(inputCols=names, outputCol=train.FEATURES).transform(plain)
    carried = []

    class Estimator:
        def fit(self, rows):
            carried.append(bytes(spark._jvm.org.apache.spark.util.Utils.serialize(rows._jdf.rdd())))
            assert rows.schema[train.FEATURES].metadata["ml_attr"] == {"num_attrs": 40}

    monkeypatch.setattr(train, "_estimator", lambda *a: Estimator())
    fit_family(df.select("example_id", train.FEATURES, "a"), ["a"], "linear_svm")
    assert len(carried) == 1 and b"named_feature_7" not in carried[0]
    binary = {"ml_attr": {"attrs": {"binary": [{"idx": 0, "name": "x"}]}, "num_attrs": 40}}
    kept = train.unnamed(df.withMetadata(train.FEATURES, binary), train.FEATURES)
    assert df.withMetadata(train.FEATURES, binary).select(kept).schema[0].metadata == binary
