"""Tokens, n-grams and writing-style measures as native column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points that count as digits though they are no decimal digits
# (superscripts, circled and other single-digit numbers).
OTHER_DIGITS = (
    r"²³¹፩-፱᧚⁰⁴-⁹₀-₉①-⑨"
    r"⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒"
    r"\x{10a40}-\x{10a43}\x{10e60}-\x{10e68}\x{11052}-\x{1105a}\x{1f100}-\x{1f10a}"
)
# Everything that counts as white space, for use inside a character class.
SPACE = r"\s\x1c-\x1f\x85\p{Z}"
# A class is tried set by set, so those that settle most characters stand apart from the long ones.
DIGIT = rf"[0-9[\x{{80}}-\x{{10ffff}}&&[\p{{Nd}}{OTHER_DIGITS}]]]"
SPECIAL = rf"[^a-z\x20[\p{{L}}\p{{N}}{SPACE}]]"
# Most characters of a text; no measure of single characters counts them.
PLAIN = r"[a-z\x20]+"

STYLE_FEATURES = [
    "word_count",
    "char_count",
    "avg_word_length",
    "exclamation_count",
    "question_count",
    "multi_punct_count",
    "all_caps_token_count",
    "title_case_ratio",
    "uppercase_char_ratio",
    "special_char_count",
    "punctuation_density",
    "digit_count",
]


def english_stop_words() -> list[str]:
    """Entries of MLlib's English list that can equal a ``\\w+`` token."""
    words = StopWordsRemover.loadDefaultStopWords("english")
    return [w for w in words if w.replace("_", "a").isalnum()]


def tokenize(text: Column, *, lowercase: bool = True, unicode: bool = False) -> Column:
    """All runs of word characters; ASCII word characters unless ``unicode`` is set."""
    pattern = r"(?U)\w+" if unicode else r"\w+"
    source = F.lower(text) if lowercase else text
    return F.regexp_extract_all(source, F.lit(pattern), F.lit(0))


def drop_stop_words(
    tokens: Column, stop_words: Sequence[str], *, lowercase: bool = True
) -> Column:
    """Tokens that are no stop words; ``isin`` on this many literals becomes a hash set."""
    words = list(stop_words)
    if not words:
        return tokens
    if lowercase:
        return F.filter(tokens, lambda t: ~t.isin(words))
    return F.filter(tokens, lambda t: ~F.lower(t).isin(words))


def word_ngrams(tokens: Column, n: int) -> Column:
    """Blank-joined n-grams; an empty array when there are fewer than ``n`` tokens.

    An n-gram is an (n-1)-gram zipped with the token that follows it, so the work per document is
    linear in its length.
    """
    if n < 1:
        raise ValueError("n-gram order must be at least 1")
    if n == 1:
        return tokens
    grams = F.size(tokens) - (n - 1)
    heads = F.slice(word_ngrams(tokens, n - 1), F.lit(1), F.greatest(grams, F.lit(0)))
    tails = F.slice(tokens, F.lit(n), F.greatest(grams, F.lit(0)))
    return F.zip_with(heads, tails, lambda head, tail: F.concat(head, F.lit(" "), tail))


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _occurrences(text: Column, character: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(character), F.lit("")))).cast("double")


def style_measures(
    text: Column, tokens: Column, *, raw_tokens: Column | None = None
) -> list[Column]:
    """The 12 style columns, in feature order.

    ``tokens`` are the filtered, lower-cased tokens. Upper-case and title-case token measures are
    zero on those by construction; pass ``raw_tokens`` (filtered, original case) to get useful ones.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.greatest(F.size(tokens), F.lit(0)).cast("double")
    chars = F.length(text).cast("double")
    letters = F.length(F.array_join(tokens, ""))
    # One pass leaves a small rest, so that the four character counts do not each read the whole text.
    rest = F.regexp_replace(text, F.lit(PLAIN), F.lit(""))
    marks = _occurrences(rest, "!")
    questions = _occurrences(rest, "?")
    # A match ends with its white-space separated segment, so a segment counts once.
    emphatic = f"[!?][!?][^{SPACE}]*"
    if raw_tokens is None:
        all_caps, titles = F.lit(0.0), F.lit(0.0)
    else:
        caps = r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$"
        title = r"^[^\p{L}]*\p{Lu}\p{Ll}*(?:[^\p{L}]+\p{Lu}\p{Ll}*)*[^\p{L}]*$"
        all_caps = F.size(
            F.filter(raw_tokens, lambda t: (F.length(t) > 1) & t.rlike(caps))
        ).cast("double")
        titles = F.size(F.filter(raw_tokens, lambda t: t.rlike(title))).cast("double")
    values = [
        words,
        chars,
        _ratio(letters, words),
        marks,
        questions,
        F.regexp_count(text, F.lit(emphatic)).cast("double"),
        all_caps,
        _ratio(titles, words),
        _ratio(F.regexp_count(rest, F.lit(r"\p{IsUppercase}")), chars),
        F.regexp_count(rest, F.lit(SPECIAL)).cast("double"),
        _ratio(marks + questions, words),
        F.regexp_count(rest, F.lit(DIGIT)).cast("double"),
    ]
    return [value.alias(name) for name, value in zip(STYLE_FEATURES, values)]
