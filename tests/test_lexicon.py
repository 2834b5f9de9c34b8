from __future__ import annotations

import pytest

from labelweave.operators import lexicon
from labelweave.sources import lexicons
from labelweave.taxonomy import LEXICON_EMOTIONS

DOCS = "k long, tokens array<string>"
TERMS = "term string, emotion string"


def measures(spark, tokens, pairs, **bounds):
    docs = spark.createDataFrame([(1, tokens)], DOCS)
    table = spark.createDataFrame(pairs, TERMS)
    return lexicon.lexicon_measures(docs, table, "k", "tokens", LEXICON_EMOTIONS, **bounds).first().asDict()


@pytest.mark.parametrize("bounds", [{}, {"max_rows": 0}])
def test_counts_ratios_flags(spark, bounds):
    pairs = [("a", "joy"), ("a", "positive"), ("b", "joy"), ("B", "joy")]
    got = measures(spark, ["a", "a", "b", "z"], pairs, **bounds)
    assert (got["lex_count_joy"], got["lex_count_positive"], got["lex_count_fear"]) == (3.0, 2.0, 0.0)
    assert (got["lex_ratio_joy"], got["lex_ratio_positive"]) == (0.75, 0.5)
    assert (got["lex_flag_joy"], got["lex_flag_positive"], got["lex_flag_fear"]) == (1.0, 1.0, 0.0)
    assert (got["lex_total_matches"], got["lex_total_ratio"]) == (3.0, 0.75)
    assert got["lex_dominant_index"] == 4.0
    assert list(got)[1:] == lexicon.lexicon_features(LEXICON_EMOTIONS)


def test_dominant_emotion_edges(spark):
    assert measures(spark, ["a", "b"], [("a", "anger"), ("b", "joy")])["lex_dominant_index"] == 0.0
    empty = measures(spark, [], [("a", "anger")])
    assert empty.pop("lex_dominant_index") == -1.0
    assert empty.pop("k") == 1 and set(empty.values()) == {0.0}
    foreign = measures(spark, ["a"], [("a", "other")])
    assert foreign["lex_total_matches"] == 1.0 and foreign["lex_dominant_index"] == 0.0


def vad(spark, tokens, rows, **bounds):
    docs = spark.createDataFrame([(1, tokens)], DOCS)
    table = spark.createDataFrame(rows, lexicons.VAD_SCHEMA)
    return lexicon.vad_measures(docs, table, "k", "tokens", **bounds).first().asDict()


@pytest.mark.parametrize("bounds", [{}, {"max_rows": 0}])
def test_vad(spark, bounds):
    rows = [("a", 0.8, 0.1, 0.5), ("b", 0.9, 0.1, 0.5), ("c", 0.7, 0.1, 0.5)]
    got = vad(spark, ["a", "b", "c", "z"], rows, **bounds)
    assert got["vad_valence_mean"] == pytest.approx(0.8)
    assert got["vad_valence_std"] == pytest.approx(0.1)
    assert got["vad_valence_range"] == pytest.approx(0.2)
    assert got["vad_token_coverage"] == 0.75
    single = vad(spark, ["a", "z"], rows, **bounds)
    assert [single[f"vad_valence_{s}"] for s in ("mean", "std", "range")] == [0.8, 0.0, 0.0]
    assert single["vad_token_coverage"] == 0.5
    assert set(vad(spark, [], rows, **bounds).values()) == {1, 0.0}


def test_duplicate_vad_terms_give_one_row(spark):
    rows = [("a", 0.5, 0.1, 0.1), ("a", 0.2, 0.9, 0.9)]
    assert vad(spark, ["a"], rows)["vad_valence_mean"] == 0.2


@pytest.mark.parametrize("bounds", [{}, {"max_rows": 0}, {"max_bytes": 10}])
def test_hot_terms_through_both_joins(spark, bounds):
    """A third of all tokens is one term; the salted join gives the same as plain counting."""
    docs = [(i, ["hot"] * (i % 5) + ["cold", f"w{i % 7}", "none"]) for i in range(300)] + [(300, [])]
    pairs = [("hot", "fear"), ("cold", "joy"), ("w3", "joy"), ("w3", "trust")]
    scores = [("hot", 0.5, 0.25, 0.125), ("w1", 1.0, 0.0, 0.5)]
    emotions = {}
    for term, emotion in pairs:
        emotions.setdefault(term, set()).add(emotion)
    terms = lexicon.term_table(
        spark.createDataFrame(pairs, TERMS), spark.createDataFrame(scores, lexicons.VAD_SCHEMA), LEXICON_EMOTIONS
    )
    df = spark.createDataFrame(docs, DOCS)
    rows = lexicon.term_measures(df, terms, "k", "tokens", LEXICON_EMOTIONS, **bounds).collect()
    assert len(rows) == 301
    by_key = {r.k: r for r in rows}
    for key, tokens in docs:
        r = by_key[key]
        assert r.lex_total_matches == sum(t in emotions for t in tokens)
        assert r.lex_count_joy == sum("joy" in emotions.get(t, ()) for t in tokens)
        assert r.lex_count_fear == tokens.count("hot")
        matched = sum(t in ("hot", "w1") for t in tokens)
        assert r.vad_token_coverage == (matched / len(tokens) if tokens else 0.0)


def test_plan_has_one_broadcast_and_one_shuffle(spark):
    df = spark.createDataFrame([(1, ["a", "b"])], DOCS)
    pairs = spark.createDataFrame([("a", "joy")], TERMS)
    out = lexicon.lexicon_measures(df, pairs, "k", "tokens", LEXICON_EMOTIONS)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert "EvalPython" not in plan and "ArrowEval" not in plan
    assert plan.count("Exchange hashpartitioning(k") == 1


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_vad_reader(spark, tmp_path):
    tabs = write(tmp_path / "a.tsv", "Term\t Valence\tAROUSAL\tDominance\tmore\nJoy\t0.9\t\t0.5\tx\n\t1\t1\t1\tx\n")
    rows = lexicons.read_vad_lexicon(spark, tabs).collect()
    assert [tuple(r) for r in rows] == [("joy", 0.9, 0.0, 0.5)]
    commas = write(tmp_path / "b.csv", "term,valence,arousal,dominance\nsad,0.1,oops,0.3\n")
    assert [tuple(r) for r in lexicons.read_vad_lexicon(spark, commas).collect()] == [("sad", 0.1, 0.0, 0.3)]
    short = write(tmp_path / "c.csv", "term,valence\nsad,0.1\n")
    with pytest.raises(ValueError):
        lexicons.read_vad_lexicon(spark, short)
    with pytest.raises(FileNotFoundError):
        lexicons.read_vad_lexicon(spark, str(tmp_path / "missing.csv"))


def test_missing_vad_lexicon_is_empty(spark, tmp_path, caplog):
    table, available = lexicons.vad_or_empty(spark, str(tmp_path / "missing.csv"))
    assert not available and table.count() == 0
    assert "no VAD lexicon at" in caplog.text
    docs = spark.createDataFrame([(1, ["a"])], DOCS)
    row = lexicon.vad_measures(docs, table, "k", "tokens").first().asDict()
    assert set(row.values()) == {1, 0.0}


def test_emotion_reader(spark, tmp_path):
    path = write(tmp_path / "e.txt", "Glad\tjoy\t1\nGlad\tfear\t0\nglad\ttrust\t1\n")
    rows = lexicons.read_emotion_lexicon(spark, path)
    assert rows.count() == 2
    sets = {r.term: r.emotions for r in lexicons.emotion_sets(rows).collect()}
    assert sets == {"glad": ["joy", "trust"]}
