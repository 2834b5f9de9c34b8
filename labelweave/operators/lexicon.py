"""Emotion-lexicon and VAD measures.

In the row: the counts of the lexicon's terms are a sparse vector of the document, and its entries look up their
weights in constant arrays; nothing is joined or shuffled, and no key is needed. By key: one explode, one lookup
join, one aggregate, for lexicons beyond ``MAX_ROW_TERMS``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.operators.linear import linear_stage
from labelweave.operators.lookup import left_lookup
from labelweave.sources.lexicons import VAD_DIMENSIONS, emotion_pairs, unique_vad_terms

#: Terms of a lexicon whose weights may stand in a plan, some tens of bytes each.
MAX_ROW_TERMS = 100_000
#: Places for flags in a long, without its sign.
MAX_FLAGS = 63


def lexicon_features(emotions: list[str]) -> list[str]:
    names = [f"lex_{kind}_{e}" for kind in ("count", "ratio", "flag") for e in emotions]
    return [*names, "lex_total_matches", "lex_total_ratio", "lex_dominant_index"]


def vad_features() -> list[str]:
    names = [f"vad_{d}_{stat}" for d in VAD_DIMENSIONS for stat in ("mean", "std", "range")]
    return [*names, "vad_token_coverage"]


def emotion_flags(pairs: DataFrame, emotions: list[str]) -> DataFrame:
    """One row per term with a 0/1 column per emotion, so a token matches at most once."""
    flags = [F.max((F.col("emotion") == e).cast("int")).alias(f"is_{e}") for e in emotions]
    return emotion_pairs(pairs).groupBy("term").agg(*flags, F.lit(1).alias("in_lexicon"))


def term_table(pairs: DataFrame, vad: DataFrame, emotions: list[str]) -> DataFrame:
    """Both lexicons side by side, one row per term."""
    scores = unique_vad_terms(vad).withColumn("in_vad", F.lit(1))
    return emotion_flags(pairs, emotions).join(scores, "term", "full_outer")


def _token_rows(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """One row per token; a document without tokens keeps one row with a NULL term."""
    return df.select(key, F.explode_outer(tokens).alias("term"))


def _or_zero(value: Column) -> Column:
    return F.coalesce(value.cast("double"), F.lit(0.0))


def _lexicon_sums(emotions: list[str]) -> list[Column]:
    sums = [F.sum(f"is_{e}").alias(f"_n_{e}") for e in emotions]
    return [*sums, F.sum("in_lexicon").alias("_matches")]


def _lexicon_columns(emotions: list[str]) -> list[Column]:
    tokens = F.greatest(F.col("_tokens"), F.lit(1)).cast("double")
    counts = {e: _or_zero(F.col(f"_n_{e}")) for e in emotions}
    matches = _or_zero(F.col("_matches"))
    in_order = F.array(*counts.values())
    dominant = F.array_position(in_order, F.array_max(in_order)).cast("double") - 1
    return [
        *[c.alias(f"lex_count_{e}") for e, c in counts.items()],
        *[(c / tokens).alias(f"lex_ratio_{e}") for e, c in counts.items()],
        *[(c > 0).cast("double").alias(f"lex_flag_{e}") for e, c in counts.items()],
        matches.alias("lex_total_matches"),
        (matches / tokens).alias("lex_total_ratio"),
        F.when(matches == 0, F.lit(-1.0)).otherwise(dominant).alias("lex_dominant_index"),
    ]


def _vad_sums() -> list[Column]:
    sums = [F.sum("in_vad").alias("_scored")]
    for d in VAD_DIMENSIONS:
        sums += [
            F.avg(d).alias(f"_{d}_mean"),
            F.stddev_samp(d).alias(f"_{d}_std"),
            (F.max(d) - F.min(d)).alias(f"_{d}_range"),
        ]
    return sums


def _vad_columns() -> list[Column]:
    tokens = F.greatest(F.col("_tokens"), F.lit(1)).cast("double")
    stats = [
        _or_zero(F.col(f"_{d}_{stat}")).alias(f"vad_{d}_{stat}")
        for d in VAD_DIMENSIONS
        for stat in ("mean", "std", "range")
    ]
    return [*stats, (_or_zero(F.col("_scored")) / tokens).alias("vad_token_coverage")]


def lexicon_measures(
    df: DataFrame, pairs: DataFrame, key: str, tokens: str, emotions: list[str], **bounds: int
) -> DataFrame:
    """``key`` and the emotion-lexicon columns of every row of ``df``."""
    rows = left_lookup(
        _token_rows(df, key, tokens), emotion_flags(pairs, emotions), "term", key, **bounds
    )
    sums = rows.groupBy(key).agg(F.count("term").alias("_tokens"), *_lexicon_sums(emotions))
    return sums.select(key, *_lexicon_columns(emotions))


def vad_measures(df: DataFrame, vad: DataFrame, key: str, tokens: str, **bounds: int) -> DataFrame:
    """``key`` and the valence/arousal/dominance columns of every row of ``df``."""
    table = unique_vad_terms(vad).withColumn("in_vad", F.lit(1))
    rows = left_lookup(_token_rows(df, key, tokens), table, "term", key, **bounds)
    sums = rows.groupBy(key).agg(F.count("term").alias("_tokens"), *_vad_sums())
    return sums.select(key, *_vad_columns())


def term_measures(
    df: DataFrame, terms: DataFrame, key: str, tokens: str, emotions: list[str], **bounds: int
) -> DataFrame:
    """Both sets of measures in one pass over the tokens.

    All tokens of a document sit in one input partition, so the partial aggregate sends about one
    narrow row per document into the only shuffle, and none if ``df`` is already clustered by key.
    """
    rows = left_lookup(_token_rows(df, key, tokens), terms, "term", key, **bounds)
    sums = rows.groupBy(key).agg(
        F.count("term").alias("_tokens"), *_lexicon_sums(emotions), *_vad_sums()
    )
    return sums.select(key, *_lexicon_columns(emotions), *_vad_columns())


@dataclass(frozen=True)
class TermWeights:
    """Terms in order; for each its flags (emotions, in a lexicon, in VAD, VAD values given) and its VAD values."""

    terms: list[str]
    flags: list[int]
    scores: dict[str, list[float]]


def term_weights(terms: DataFrame, emotions: list[str]) -> TermWeights | None:
    """Weights of a stored term table, or None if it has too many terms or emotions for constant arrays."""
    names = [*[f"is_{e}" for e in emotions], "in_lexicon", "in_vad"]
    known = terms.filter(F.col("term").isNotNull())
    if len(names) + len(VAD_DIMENSIONS) > MAX_FLAGS or known.count() > MAX_ROW_TERMS:
        return None
    rows = sorted(known.collect(), key=lambda row: row["term"])
    flags = []
    for row in rows:
        marks = [row[n] == 1 for n in names] + [row[d] is not None for d in VAD_DIMENSIONS]
        flags.append(sum(1 << i for i, mark in enumerate(marks) if mark))
    scores = {d: [row[d] or 0.0 for row in rows] for d in VAD_DIMENSIONS}
    if not rows:  # no token is empty, so this term counts nothing
        return TermWeights([""], [0], {d: [0.0] for d in VAD_DIMENSIONS})
    return TermWeights([row["term"] for row in rows], flags, scores)


def _constants(values: list, kind: str) -> Column:
    """An array of constants as one literal, once the optimizer has folded it."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def row_measures(
    df: DataFrame, counts: str, tokens: Column, weights: TermWeights, emotions: list[str], keep: list[str]
) -> DataFrame:
    """``keep`` and both sets of measures, from the sparse vector ``counts`` of the terms of ``weights``.

    Sums are one product with the matrix of the terms' weights; extremes and deviations of a document are taken
    over the entries of its own vector.
    """
    names = [*emotions, "in_lexicon", "in_vad", *VAD_DIMENSIONS]
    place = {name: i for i, name in enumerate(names)}
    marks = np.array(weights.flags, np.int64)
    marked = [(marks >> i & 1).astype(np.float64) for i in range(len(names))]
    matrix = np.vstack([*marked, *[np.array(weights.scores[d], np.float64) for d in VAD_DIMENSIONS]])
    summing = linear_stage(matrix, np.zeros(len(matrix)), counts, "_sums")

    vector = F.unwrap_udt(counts)
    flags = _constants(weights.flags, "long")
    scores = {d: _constants(weights.scores[d], "double") for d in VAD_DIMENSIONS}
    entry = lambda i, c: F.struct(
        c.alias("n"), F.get(flags, i).alias("flags"), *[F.get(v, i).alias(d) for d, v in scores.items()]
    )
    met = F.zip_with(vector.getField("indices"), vector.getField("values"), entry)
    scored = F.filter(met, lambda e: e["flags"] >= 1 << place["in_vad"])
    totals = F.unwrap_udt("_sums").getField("values")
    rows = summing.transform(df).select(*keep, tokens.alias("_tokens"), scored.alias("_met"), totals.alias("_sums"))

    def times(e: Column, flag: str) -> Column:
        """How often the entry's term occurs if it has the flag, else 0."""
        return e["n"] * F.shiftright(e["flags"], place[flag]).bitwiseAND(F.lit(1)).cast("double")

    def away(d: str) -> Column:
        off = lambda e: e[d] - F.col(f"_{d}_mean")
        return F.aggregate("_met", F.lit(0.0), lambda a, e: a + times(e, d) * off(e) * off(e))

    def found(d: str) -> Column:
        return F.transform(F.filter("_met", lambda e: times(e, d) > 0), lambda e: e[d])

    total = lambda i: F.get("_sums", F.lit(i))
    sums = [total(place[e]).alias(f"_n_{e}") for e in emotions]
    sums += [total(place["in_lexicon"]).alias("_matches"), total(place["in_vad"]).alias("_scored")]
    for i, d in enumerate(VAD_DIMENSIONS):
        width = F.array_max(found(d)) - F.array_min(found(d))
        value_sum = total(len(names) + i)
        sums += [total(place[d]).alias(f"_{d}_given"), value_sum.alias(f"_{d}_sum"), width.alias(f"_{d}_range")]
    summed = rows.select("*", *sums)
    means = [F.try_divide(F.col(f"_{d}_sum"), F.col(f"_{d}_given")).alias(f"_{d}_mean") for d in VAD_DIMENSIONS]
    centred = summed.select("*", *means)
    spreads = []
    for d in VAD_DIMENSIONS:
        variance = F.when(F.col(f"_{d}_given") > 1, away(d) / (F.col(f"_{d}_given") - 1))
        spreads.append(F.sqrt(variance).alias(f"_{d}_std"))
    return centred.select("*", *spreads).select(*keep, *_lexicon_columns(emotions), *_vad_columns())
