from __future__ import annotations

import math
from collections import Counter

import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import IDF, CountVectorizer, NGram
from pyspark.sql import functions as F

from labelweave.operators import train, vocabulary
from labelweave.operators.features import (
    FeatureModel,
    FeatureParams,
    feature_width,
    fit_features,
    with_tokens,
)
from labelweave.sources import artifacts
from labelweave.taxonomy import LEXICON_EMOTIONS

PARAMS = FeatureParams(max_vocab=60, min_df=3, ngram_orders=(2, 1))


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("example_id"), "text")


@pytest.fixture(scope="module")
def lexica(spark):
    pairs = spark.createDataFrame([("this", "joy"), ("ened", "fear")], "term string, emotion string")
    vad = spark.createDataFrame(
        [("ened", -0.5, 0.25, 0.5)], "term string, valence double, arousal double, dominance double"
    )
    return pairs, vad


@pytest.fixture(scope="module")
def model(spark, docs, lexica):
    return fit_features(docs, *lexica, LEXICON_EMOTIONS, PARAMS)


def test_statistics_equal_counting(spark, docs):
    bags = [r.tokens for r in with_tokens(docs).select("tokens").collect()]
    stats = vocabulary.term_statistics(with_tokens(docs), "tokens", [1, 2]).collect()
    got = {(r.n, r.term): (r.occurrences, r.documents) for r in stats}
    want = {}
    for n in (1, 2):
        grams = [[" ".join(b[i : i + n]) for i in range(len(b) - n + 1)] for b in bags]
        every = Counter(g for bag in grams for g in bag)
        once = Counter(g for bag in grams for g in set(bag))
        want |= {(n, g): (c, once[g]) for g, c in every.items()}
    assert got == want


def shuffled_rows(df):
    """Rows that the job's exchanges wrote, from the metrics of the plan that ran."""
    df.collect()
    plan, total, open_nodes = df._jdf.queryExecution().executedPlan(), 0, []
    open_nodes.append(plan)
    while open_nodes:
        node = open_nodes.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            open_nodes.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            open_nodes.append(node.plan())
        if kind == "ShuffleExchangeExec":
            total += node.metrics().apply("shuffleRecordsWritten").value()
        children = node.children()
        open_nodes += [children.apply(i) for i in range(children.size())]
    return total


@pytest.mark.parametrize("bounds", [{}, {"max_rows": 0}])
def test_frequent_terms_equal_counting_all(spark, docs, bounds):
    words = with_tokens(docs).select("tokens")
    for orders, least in (([1, 2, 3], 3), ([3], 2), ([2, 1], 5), ([1, 4], 2)):
        want = vocabulary.term_statistics(words, "tokens", orders).filter(F.col("documents") >= least).collect()
        got = vocabulary.frequent_terms(words, "tokens", orders, least, **bounds).collect()
        key = lambda r: (r.n, r.term, r.occurrences, r.documents)
        assert sorted(map(key, got)) == sorted(map(key, want)) and want


def test_most_long_terms_are_never_shuffled(spark, docs):
    words = with_tokens(docs).select("tokens")
    pairs = vocabulary.frequent_terms(words, "tokens", [2], 3)
    every = shuffled_rows(vocabulary.term_statistics(words, "tokens", [3]))
    candidates = shuffled_rows(vocabulary.candidate_statistics(words, "tokens", 3, pairs))
    assert 0 < candidates < every / 2


@pytest.mark.parametrize("size", [1, 7, 100_000])
def test_vocabulary_limits(spark, docs, size):
    words = with_tokens(docs).select("tokens")
    every = vocabulary.term_statistics(words, "tokens", [1]).filter("documents >= 3").collect()
    want = [r.term for r in sorted(every, key=lambda r: (-r.occurrences, r.term))][:size]
    got = vocabulary.vocabularies(words, "tokens", [1], max_vocab=size, min_df=3)
    assert [r.term for r in got.orderBy("index").collect()] == want
    assert [r["index"] for r in got.orderBy("index").collect()] == list(range(len(want)))


def test_idf_below_minimum_is_zero(spark):
    df = spark.createDataFrame([(["a", "b"],), (["a"],), (["a"],)], "tokens array<string>")
    got = vocabulary.vocabularies(df, "tokens", [1], min_df=1, idf_min_doc_freq=2)
    weights = {r.term: r.idf for r in got.collect()}
    assert weights == {"a": math.log(4 / 4), "b": 0.0}


def test_tfidf_equals_library(spark, docs, model):
    tokens = with_tokens(docs, output="t")
    grams = NGram(n=2, inputCol="t", outputCol="g").transform(tokens)
    counter = CountVectorizer(inputCol="g", outputCol="tf", vocabSize=60, minDF=3).fit(grams)
    weighted = IDF(inputCol="tf", outputCol="w").fit(counter.transform(grams)).transform(counter.transform(grams))
    mine = model.measure(docs).select("example_id", "tfidf_2gram")
    ours = next(s for s in model.text_stages.stages if s.hasParam("vocabSize") and s.getInputCol() == "_2gram")
    # Ties at the end of the vocabulary may be cut differently by the library.
    shared = set(ours.vocabulary) & set(counter.vocabulary)
    assert len(shared) > 40
    mine_rows = {r.example_id: r.tfidf_2gram for r in mine.collect()}
    place = {t: i for i, t in enumerate(ours.vocabulary)}
    for r in weighted.select("example_id", "w").collect():
        for i, term in enumerate(counter.vocabulary):
            if term in shared:
                assert mine_rows[r.example_id][place[term]] == pytest.approx(r.w[i], abs=1e-12)


def test_assembled_width_and_order(spark, docs, model):
    out = model.transform(docs)
    width = feature_width(out)
    assert width == 60 + 60 + 33 + 10 + 12
    assert out.columns == ["example_id", "text", "features"]
    assert feature_width(docs) is None
    row = model.measure(docs).join(out.select("example_id", "features"), "example_id").first()
    assert row.features.toArray()[-12] == row.word_count
    assert row.features.toArray()[120] == row.lex_count_anger
    assert out.count() == docs.count()


def test_non_negative_vectors(spark, docs, model):
    measured = model.measure(docs)
    assert measured.agg(F.min("lex_dominant_index")).first()[0] == -1.0
    clipped = model.assemble(measured, "v", non_negative=True)
    low = clipped.select(F.array_min(F.unwrap_udt("v").getField("values")).alias("m")).agg(F.min("m")).first()[0]
    assert low >= 0.0
    assert feature_width(clipped, "v") == 175


def test_feature_plan_stays_in_the_jvm(spark, docs, model):
    plan = model.transform(docs)._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "ArrowEval" not in plan and "Python" not in plan


def test_measuring_is_one_scan_without_a_shuffle(docs, model):
    plan = model.measure(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Aggregate" not in plan
    assert plan.count("FileScan") == 1


def wordy(spark):
    """Keys that are missing or repeated; each row has its own words."""
    rows = [(2, "this ened ened"), (2, "other words here"), (None, "this this this"), (None, None), (3, ""), (2, "this ened ened")]
    return spark.createDataFrame(rows, "example_id long, text string")


@pytest.mark.parametrize("in_row", [True, False])
def test_rows_with_missing_or_repeated_keys_keep_their_own_measures(spark, model, in_row):
    chosen = model if in_row else FeatureModel(model.text_stages, model.terms, model.orders, model.emotions)
    got = sorted(
        (r.example_id or 0, r.text or "", r.lex_total_matches, r.vad_token_coverage, r.word_count)
        for r in chosen.measure(wordy(spark)).collect()
    )
    want = [(0, "", 0.0, 0.0, 0.0), (0, "this this this", 0.0, 0.0, 0.0), (2, "other words here", 0.0, 0.0, 1.0)]
    want += [(2, "this ened ened", 2.0, 1.0, 2.0)] * 2 + [(3, "", 0.0, 0.0, 0.0)]
    assert got == want


def test_measures_in_the_row_equal_those_by_join(spark, sf_dir, docs):
    from labelweave.catalog import fixtures as fx

    pairs, vad = fx.emotion_lexicon(spark, sf_dir), fx.vad_lexicon(spark, sf_dir)
    holes = vad.withColumn("arousal", F.when(F.length("term") > 4, F.col("arousal")))
    fitted = fit_features(docs, pairs, holes, LEXICON_EMOTIONS, PARAMS)
    joined = FeatureModel(fitted.text_stages, fitted.terms, fitted.orders, fitted.emotions)
    want = {r.example_id: r for r in joined.measure(docs).collect()}
    for r in fitted.measure(docs).collect():
        for name in fitted.scalar_columns:
            assert r[name] == pytest.approx(want[r.example_id][name], abs=1e-12), name


def test_large_lexicons_are_joined(spark, lexica, docs, monkeypatch):
    from labelweave.operators import lexicon

    monkeypatch.setattr(lexicon, "MAX_ROW_TERMS", 1)
    large = fit_features(docs, *lexica, LEXICON_EMOTIONS, PARAMS)
    assert large.weights is None and large.measure(docs).count() == docs.count()


def test_an_empty_lexicon_gives_zeros(spark, docs):
    empty = spark.createDataFrame([], "term string, emotion string")
    vad = spark.createDataFrame([], "term string, valence double, arousal double, dominance double")
    row = fit_features(docs, empty, vad, LEXICON_EMOTIONS, PARAMS).measure(docs).first()
    assert row.lex_total_matches == 0.0 and row.lex_dominant_index == -1.0 and row.vad_valence_mean == 0.0


def test_clustered_examples_need_no_shuffle(spark, docs, model, tmp_path):
    path = str(tmp_path / "clustered")
    landed = artifacts.land_clustered(docs, path, "clustered_docs", "example_id", 4)
    plan = model.measure(landed)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(example_id" not in plan
    again = artifacts.open_clustered(spark, path, "clustered_again", "example_id", 4)
    plan = model.measure(again)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(example_id" not in plan
    assert again.count() == docs.count()
    assert artifacts.open_clustered(spark, str(tmp_path / "none"), "t", "example_id", 4) is None


def test_save_and_load(spark, docs, model, tmp_path):
    model.save(str(tmp_path / "m"))
    loaded = FeatureModel.load(spark, str(tmp_path / "m"))
    want = {r.example_id: r.features for r in model.transform(docs).collect()}
    assert {r.example_id: r.features for r in loaded.transform(docs).collect()} == want


def test_orders_without_frequent_terms_are_left_out(spark, lexica):
    df = spark.createDataFrame([(1, "alpha beta"), (2, "alpha gamma")], "example_id long, text string")
    small = fit_features(df, *lexica, LEXICON_EMOTIONS, FeatureParams(min_df=2))
    assert small.tfidf_columns == ["tfidf_1gram"]
    assert feature_width(small.transform(df)) == 1 + 55


def test_naive_bayes_parameters_equal_library(spark, docs, sf_dir):
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet").selectExpr(
        "doc_id AS example_id", "double(quality) AS quality", "double(toxic) AS toxic"
    )
    rows = with_tokens(docs.join(marks, "example_id"))
    learned = vocabulary.vocabularies(rows, "tokens", [1], max_vocab=25, min_df=2).cache()
    entries = vocabulary.tfidf_rows(rows, "example_id", "tokens", learned, 1)
    got = train.naive_bayes_parameters(
        entries.select("example_id", "term", F.col("tf").alias("value")),
        rows.select("example_id", "quality", "toxic"), learned, ["quality", "toxic"], "example_id",
    )
    from pyspark.ml.feature import CountVectorizerModel

    words = [r.term for r in learned.orderBy("index").collect()]
    counted = CountVectorizerModel.from_vocabulary(words, inputCol="tokens", outputCol="tf").transform(rows)
    for label in ("quality", "toxic"):
        fitted = NaiveBayes(featuresCol="tf", labelCol=label).fit(counted)
        cells = {(r["class"], r.term): (r.theta, r.pi) for r in got.filter(F.col("label") == label).collect()}
        for k in (0, 1):
            for i, term in enumerate(words):
                theta, pi = cells[(k, term)]
                assert theta == pytest.approx(fitted.theta.toArray()[k][i])
                assert pi == pytest.approx(fitted.pi[k])


def test_missing_texts_are_measured_as_empty(spark, model):
    df = spark.createDataFrame([(1, None), (2, "")], "example_id long, text string")
    rows = {r.example_id: r for r in model.transform(df).collect()}
    assert rows[1].text is None and rows[2].text == ""
    assert rows[1].features == rows[2].features


def test_all_documents_get_features(spark, sf_dir):
    from __spark_entry__ import queries

    known = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()
    marked = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id").collect()
    assert queries()["feature_table_all"] is queries()["feature_table"]
    rows = queries()["feature_table"](spark, sf_dir).collect()
    assert sorted(r.example_id for r in rows) == sorted(r.doc_id for r in known)
    assert {r.example_id for r in rows if r.split} == {r.doc_id for r in marked} < {r.doc_id for r in known}
    assert any(r.tfidf_1gram_sum for r in rows if not r.split)


def test_weights_of_all_orders(spark, sf_dir):
    from __spark_entry__ import queries

    rows = queries()["tfidf_long_all"](spark, sf_dir)
    assert {r.n for r in rows.select("n").distinct().collect()} == {1, 2, 3}
    assert all(len(r.term.split(" ")) == r.n for r in rows.filter("n > 1").limit(200).collect())


def test_leading_terms_do_not_shuffle_the_rare_ones(spark):
    """Of 30,000 pairs that many documents have, few more than the wanted ones are counted by name."""
    rows = spark.range(30_000).select(
        F.concat(F.lit("w"), F.pmod("id", F.lit(10_000)).cast("string")).alias("a"),
        F.concat(F.lit("v"), F.col("id").cast("string")).alias("b"), F.lit("top").alias("c"), F.lit("pair").alias("d"),
    )
    df = rows.select(F.array("a", "b", "c", "d").alias("tokens"))
    found = vocabulary.leading_terms(df, "tokens", [2], 1, 1).collect()
    assert ("top pair", 30_000, 30_000) in [(r.term, r.occurrences, r.documents) for r in found] and len(found) < 100


@pytest.mark.parametrize("buckets", [8, 1 << 20])
def test_leading_terms_equal_counting_whatever_shares_a_bucket(spark, docs, buckets):
    words = with_tokens(docs).select("tokens").limit(60)
    odd = spark.createDataFrame([(None,), ([],), (["a", None, "b", "a"],), (["a"],), (["b", "a"],)], "tokens array<string>")
    words = words.unionByName(odd).cache()
    every = vocabulary.term_statistics(words, "tokens", [1, 2, 3]).filter("documents >= 2").collect()
    for size in (40, 100_000):
        got = vocabulary.leading_terms(words, "tokens", [1, 2, 3], 2, size, buckets).collect()
        for n in (1, 2, 3):
            best = lambda rows: sorted((-r.occurrences, r.term, r.documents) for r in rows if r.n == n)[:size]  # noqa: B023, E731
            assert best(got) == best(every) and best(every)


def test_rare_terms_that_share_buckets_cost_no_second_pass(spark, monkeypatch):
    """About 60 rare terms share each bucket; the 100 terms that 40 documents have are still found in one pass."""
    rows = spark.range(64_000).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("a"))
    often = spark.range(4_000).select(F.concat(F.lit("t"), F.pmod("id", F.lit(100)).cast("string")).alias("a"))
    df = rows.unionByName(often).select(F.array("a").alias("tokens"))
    passes, count = [], vocabulary._term_batches
    monkeypatch.setattr(vocabulary, "_term_batches", lambda marks: passes.append(marks) or count(marks))
    found = vocabulary.leading_terms(df, "tokens", [1], 2, 100, 1 << 10).collect()
    assert {(r.term, r.occurrences, r.documents) for r in found} == {(f"t{i}", 40, 40) for i in range(100)}
    assert len(passes) == 1


def test_lexicon_sums_are_one_product(spark, model, docs):
    """Only the deviations of the three VAD values are folded entry by entry."""
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        plan = model.measure(docs)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("aggregate(") == 3


def test_terms_reach_the_jvm_without_a_call_for_each(spark, monkeypatch):
    from pyspark.ml.feature import CountVectorizerModel

    terms = ["a", "b c", "d|e", "\x01f", "é€𝄞", ""]
    df = spark.createDataFrame([(["b c", "a", "", "a", "d|e", "\x01f", "é€𝄞", "other"],)], "g array<string>")
    want = CountVectorizerModel.from_vocabulary(terms, inputCol="g", outputCol="v").transform(df).first().v
    # Terms that hold every mark are handed over one by one.
    marked = ["a\n", "b\x00", "c\x1f"]
    assert vocabulary.term_counter(marked, "g", "v").vocabulary == marked
    assert vocabulary.term_counter(["a\nb", ""], "g", "v").vocabulary == ["a\nb", ""]

    def refuse(*_):
        raise AssertionError("one call for each term")

    monkeypatch.setattr(CountVectorizerModel, "_new_java_array", refuse)
    counter = vocabulary.term_counter(terms, "g", "v")
    assert counter.vocabulary == terms and counter.getVocabSize() == len(terms)
    assert counter.transform(df).first().v == want
