from __future__ import annotations

import pytest
from pyspark.ml.feature import NGram, RegexTokenizer, StopWordsRemover
from pyspark.sql import functions as F

from labelweave.catalog.oracle import STOP_WORDS
from labelweave.functions import text
from labelweave.functions.text import (
    drop_stop_words,
    english_stop_words,
    style_measures,
    tokenize,
    word_ngrams,
)
from labelweave.operators.features import with_tokens


def one(spark, column, **values):
    names = list(values)
    schema = ", ".join(
        f"{n} {'array<string>' if isinstance(v, list) else 'string'}" for n, v in values.items()
    )
    return spark.createDataFrame([tuple(values[n] for n in names)], schema).select(column).first()[0]


def test_tokens(spark):
    text = "Größe über café I'm SO_HAPPY 42!"
    got = one(spark, tokenize(F.col("t")), t=text)
    assert got == ["gr", "e", "ber", "caf", "i", "m", "so_happy", "42"]
    wide = one(spark, tokenize(F.col("t"), unicode=True), t=text)
    assert wide[:3] == ["größe", "über", "café"]
    assert one(spark, tokenize(F.col("t")), t="?!") == []
    assert one(spark, tokenize(F.col("t")), t=None) is None


def test_stop_words_are_the_library_list(spark):
    assert english_stop_words() == STOP_WORDS
    kept = one(spark, drop_stop_words(F.col("t"), STOP_WORDS), t=["the", "cat", "and", "cat"])
    assert kept == ["cat", "cat"]
    mixed = drop_stop_words(F.col("t"), STOP_WORDS, lowercase=False)
    assert one(spark, mixed, t=["The", "Cat"]) == ["Cat"]
    assert one(spark, drop_stop_words(F.col("t"), []), t=["the"]) == ["the"]


@pytest.mark.parametrize(
    ("n", "want"), [(1, ["a", "b", "c"]), (2, ["a b", "b c"]), (3, ["a b c"]), (4, []), (5, [])]
)
def test_ngrams(spark, n, want):
    assert one(spark, word_ngrams(F.col("t"), n), t=["a", "b", "c"]) == want
    assert one(spark, word_ngrams(F.col("t"), n), t=[]) == []


def test_native_text_equals_library_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    staged = RegexTokenizer(inputCol="text", outputCol="a", pattern=r"\w+", gaps=False).transform(docs)
    staged = StopWordsRemover(inputCol="a", outputCol="b").transform(staged)
    staged = NGram(n=3, inputCol="b", outputCol="c").transform(staged)
    want = {r.doc_id: (r.b, r.c) for r in staged.collect()}
    native = with_tokens(docs).select("doc_id", "tokens", word_ngrams(F.col("tokens"), 3).alias("g"))
    assert {r.doc_id: (r.tokens, r.g) for r in native.collect()} == want


def style(spark, text, tokens, raw=None):
    df = spark.createDataFrame([(text, tokens, raw)], "x string, t array<string>, r array<string>")
    raw_column = None if raw is None else F.col("r")
    return df.select(*style_measures(F.col("x"), F.col("t"), raw_tokens=raw_column)).first().asDict()


def test_style_measures(spark):
    got = style(spark, "NOW the tram is LATE!! We're SO cold!!!", ["now", "tram", "late", "cold"])
    assert got == {
        "word_count": 4.0,
        "char_count": 39.0,
        "avg_word_length": 3.75,
        "exclamation_count": 5.0,
        "question_count": 0.0,
        "multi_punct_count": 2.0,
        "all_caps_token_count": 0.0,
        "title_case_ratio": 0.0,
        "uppercase_char_ratio": 10 / 39,
        "special_char_count": 6.0,
        "punctuation_density": 1.25,
        "digit_count": 0.0,
    }


def test_style_questions_without_words(spark):
    got = style(spark, "What?! No?? a!b?", [])
    assert (got["exclamation_count"], got["question_count"]) == (2.0, 4.0)
    assert (got["multi_punct_count"], got["special_char_count"]) == (2.0, 6.0)
    assert got["punctuation_density"] == got["avg_word_length"] == got["word_count"] == 0.0


def test_style_of_nothing(spark):
    assert set(style(spark, None, None).values()) == {0.0}
    assert set(style(spark, "", []).values()) == {0.0}


def test_style_raw_case_and_digits(spark):
    got = style(spark, "NASA Sent 3² Probes", ["x"] * 4, ["NASA", "Sent", "3", "Probes"])
    assert got["all_caps_token_count"] == 1.0
    assert got["title_case_ratio"] == 0.5
    assert got["digit_count"] == 2.0


def python_style(text):
    """The character measures in plain Python."""
    return (
        sum(any(p in s for p in ("!!", "??", "?!", "!?")) for s in text.split()),
        sum(c.isupper() for c in text),
        sum(not c.isalnum() and not c.isspace() for c in text),
        sum(c.isdigit() for c in text),
    )


def test_character_classes_on_all_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame(
        [(-1, "a !!b ?! x ①²५ Ⅷ ǅ \u0085y"), (-2, "!" * 5000 + "x" * 5000)], "doc_id long, text string"
    )
    rows = docs.union(extra).select(
        "doc_id", "text", *style_measures(F.col("text"), F.array().cast("array<string>"))
    ).collect()
    for r in rows:
        upper = round(r.uppercase_char_ratio * r.char_count)
        got = (r.multi_punct_count, upper, r.special_char_count, r.digit_count)
        assert got == python_style(r.text), r.doc_id


def test_character_classes_hold_for_every_code_point(spark):
    points = spark.range(0x110000).filter("id < 55296 or id > 57343")
    points = points.select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    plain = {
        text.DIGIT: rf"[\p{{Nd}}{text.OTHER_DIGITS}]",
        text.SPECIAL: rf"[^\p{{L}}\p{{N}}{text.SPACE}]",
    }
    for made, want in plain.items():
        assert points.filter(F.col("c").rlike(made) != F.col("c").rlike(want)).count() == 0


def test_a_segment_with_several_runs_of_marks_counts_once(spark):
    rows = spark.createDataFrame([("a!!b??c d! ?e !? !!!\u00a0x?!",)], "text string")
    found = rows.select(*text.style_measures(F.col("text"), F.array())).first()
    assert found["multi_punct_count"] == 4.0


def test_whole_texts_are_searched_twice_only(spark):
    """For runs of marks, and to leave the rest that all counts of characters read."""
    from labelweave.functions.text import style_measures

    rows = spark.createDataFrame([("Ab c!? ٣² Ωω É #! x", ["ab", "x"])], "text string, tokens array<string>")
    measured = rows.select(*style_measures(F.col("text"), F.col("tokens")))
    plan = measured._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_count(coalesce(text") == 1 and plan.count("regexp_count(regexp_replace(") == 3
    got = measured.first()
    assert (got.exclamation_count, got.question_count, got.multi_punct_count) == (2.0, 1.0, 1.0)
    assert (got.uppercase_char_ratio, got.special_char_count, got.digit_count) == (3 / 19, 4.0, 2.0)
