"""Quality rules as learned decision lists.

Statistics of each text are columns; a list of rules is learned from the ones with labels. Sequential covering
takes one rule after the other: conditions (a statistic at most or above a threshold) are added while they
raise the gain on the growing part, then dropped from the end while that does not lower the precision on the
pruning part; the rows that a rule covers leave the rest. The list is an ordered conditional expression.

Growing needs one small aggregate for each condition (labels by statistic and threshold bin); no row reaches
the driver.

Defined cases: a NULL or empty text has all counts 0; without labels, or with one class, the list is empty and
keeps everything; repeated rows count as often as they occur.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.llm.words import (
    IS_SPACE,
    Texts,
    covered,
    find_words,
    mix,
    per_text,
    span_hashes,
    text_chunks,
    window_hashes,
    window_starts,
    word_hashes,
)
from labelweave.scratch import settle

#: Words in a window whose repetition counts.
WINDOW = 5
# Characters that count as symbols.
SYMBOLS = "#*$%&|<>"

_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_IS_UPPER = np.zeros(256, dtype=bool)
_IS_UPPER[ord("A") : ord("Z") + 1] = True
_IS_MARK = np.zeros(256, dtype=bool)
_IS_MARK[[ord(c) for c in "!?"]] = True
_IS_DIGIT = np.zeros(256, dtype=bool)
_IS_DIGIT[ord("0") : ord("9") + 1] = True

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_same_next", "n_upper",
    "n_marks", "n_digits",
)


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(keys), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return again


def text_counts(texts: Texts) -> dict[str, np.ndarray]:
    """The counts of each text."""
    words = find_words(texts)
    hashes = word_hashes(texts, words)
    data, offsets = texts.data, texts.offsets
    letters = ((data & 0xC0) != 0x80) & ~IS_SPACE[data]  # the first byte of each code point in a word

    starts = window_starts(words, WINDOW)
    windows = window_hashes(hashes, WINDOW)[starts] if len(starts) else np.zeros(0, np.uint64)
    again = _repeats(windows ^ mix(words.doc[starts].astype(np.uint64), 1))
    repeated = covered(starts[again], WINDOW, len(hashes))

    # Lines run from a text's start or a line feed to the next line feed or the text's end.
    feeds = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([offsets[:-1], feeds + 1]))
    line_start = line_start[line_start < len(data)]
    line_doc = np.searchsorted(offsets, line_start, side="right") - 1
    next_feed = np.append(feeds, len(data))[np.searchsorted(feeds, line_start)]
    line_end = np.minimum(next_feed, offsets[line_doc + 1])
    has_word = np.searchsorted(words.starts, line_start) < np.searchsorted(words.starts, line_end)
    line_start, line_end, line_doc = line_start[has_word], line_end[has_word], line_doc[has_word]
    keys = span_hashes(data, line_start, line_end) ^ mix(line_doc.astype(np.uint64), 2)
    distinct = np.unique(keys, return_index=True)[1]
    n_lines = np.bincount(line_doc, minlength=len(texts))
    n_distinct = np.bincount(line_doc[distinct], minlength=len(texts))

    same_next = (hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
    return {
        "n_words": words.counts(),
        "word_chars": per_text(letters, offsets),
        "n_symbols": per_text(_IS_SYMBOL[data], offsets),
        "n_dup_lines": n_lines - n_distinct,
        "n_repeat_words": per_text(repeated, words.first),
        "n_lines": n_lines,
        "n_same_next": np.bincount(words.doc[1:][same_next], minlength=len(texts)),
        "n_upper": per_text(_IS_UPPER[data], offsets),
        "n_marks": per_text(_IS_MARK[data], offsets),
        "n_digits": per_text(_IS_DIGIT[data], offsets),
    }


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in text_chunks(batch.column(1)):
            counts = text_counts(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(texts.first, len(texts)),
                    *(pa.array(counts[c].astype(np.int64)) for c in COUNTS),
                ],
                ["doc_id", *COUNTS],
            )


def document_counts(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the counts of each row, from one pass over the texts."""
    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    return rows.mapInArrow(_count_batches, f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}")


def _ratio(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)


def feature_columns() -> dict[str, Column]:
    """What conditions may speak about, as expressions over the counts."""
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word_chars": _ratio("word_chars", "n_words"),
        "symbols_per_word": _ratio("n_symbols", "n_words"),
        "dup_line_share": _ratio("n_dup_lines", "n_lines"),
        "repeat_share": _ratio("n_repeat_words", "n_words"),
        "same_next_share": _ratio("n_same_next", "n_words"),
        "upper_share": _ratio("n_upper", "word_chars"),
        "marks_per_word": _ratio("n_marks", "n_words"),
        "digits_per_word": _ratio("n_digits", "n_words"),
    }


#: Smallest share of the rows that a threshold parts off; quantiles are exact to half of it.
TAIL_SHARE = 1 / (1 << 16)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, value: Column) -> Column:
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass
class DecisionList:
    """Ordered conjunctions; the first that holds names the reason, none means keep."""

    rules: list[tuple[Condition, ...]] = field(default_factory=list)

    def reason(self, features: dict[str, Column]) -> Column:
        """Text of the first rule that holds, else NULL: one ordered conditional expression."""
        out = F.lit(None).cast("string")
        for rule in reversed(self.rules):
            holds = F.lit(True)
            for c in rule:
                holds = holds & c.column(features[c.feature])
            out = F.when(holds, F.lit(" AND ".join(map(str, rule)))).otherwise(out)
        return out


def _information(p: float, n: float) -> float:
    return math.log2(p / (p + n)) if p else -math.inf


def learn_decision_list(
    labelled: DataFrame,
    features: dict[str, Column],
    bad: Column,
    *,
    bins: int = 64,
    max_rules: int = 16,
    max_conditions: int = 4,
    min_precision: float = 0.9,
    min_covered: int = 5,
    grow_share: float = 2 / 3,
    seed: int = 0,
) -> DecisionList:
    """Rules for the rows with ``bad``, by sequential covering over all labelled rows.

    Thresholds lie half-way between quantiles of each feature. The first and last of the ``bins`` are halved again and
    again, down to a share of ``TAIL_SHARE`` of the rows, as junk lies in the tails. A rule is taken if at least ``min_covered`` rows of both parts
    are bad and covered, and ``min_precision`` of the covered rows are bad on the pruning part.
    """
    names = list(features)
    rows = labelled.select(
        bad.alias("_bad"),
        # Parts follow the values, so that rerunning gives the same parts whatever the order of rows.
        (F.pmod(F.xxhash64(*labelled.columns, F.lit(seed)), F.lit(3000)) < int(3000 * grow_share)).alias("_grow"),
        *[features[n].alias(n) for n in names],
    ).filter("_bad IS NOT NULL")
    tails = []
    while (tails[-1] if tails else 1 / bins) > TAIL_SHARE:
        tails.append((tails[-1] if tails else 1 / bins) / 2)
    quantiles = sorted({0.0, *tails, *[i / bins for i in range(1, bins)], *[1 - t for t in tails], 1.0})
    found = rows.select(
        *[F.percentile_approx(n, quantiles, int(2 / TAIL_SHARE)).alias(n) for n in names]
    ).first()
    # Half-way between values, so that a rule does not lean on the exact values seen.
    cuts = {}
    for n in names:
        values = sorted(set(found[n] or []))
        cuts[n] = [(a + b) / 2 for a, b in zip(values[:-1], values[1:])]
    binned = settle(
        rows.select(
            "_bad",
            "_grow",
            *[sum([(F.col(n) > t).cast("int") for t in cuts[n]], F.lit(0)).alias(n) for n in names],
        )
        .groupBy("_bad", "_grow", *names)
        .count(),
        "binned",
    )

    def holds(rule: Sequence[tuple[str, bool, int]]) -> Column:
        out = F.lit(True)
        for name, above, k in rule:
            out = out & ((F.col(name) > k) if above else (F.col(name) <= k))
        return out

    def statistics(where: Column) -> dict[tuple[str, bool], np.ndarray]:
        """Good and bad rows by bin, for each feature and part."""
        pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("bin")) for n in names])
        counted = (
            binned.filter(where)
            .select("_bad", "_grow", "count", F.inline(pairs))
            .groupBy("_bad", "_grow", "feature", "bin")
            .agg(F.sum("count").alias("n"))
        )
        out = {(n, g): np.zeros((2, len(cuts[n]) + 1)) for n in names for g in (False, True)}
        for r in counted.collect():  # at most 4 * features * bins rows
            out[r["feature"], r["_grow"]][int(r["_bad"]), r["bin"]] += r["n"]
        return out

    learned = DecisionList()
    taken: list[list[tuple[str, bool, int]]] = []
    while len(taken) < max_rules:
        rest = F.lit(True)
        for rule in taken:
            rest = rest & ~holds(rule)
        rule: list[tuple[str, bool, int]] = []
        scored: list[tuple[float, float, float]] = []
        counts = statistics(rest)
        good, wrong = counts[names[0], True].sum(axis=1)
        while wrong and good and len(rule) < max_conditions:
            best = None
            for name in names:
                below = np.cumsum(counts[name, True], axis=1)
                total = below[:, -1]
                for k in range(len(cuts[name])):
                    for above in (True, False):
                        n, p = (total - below[:, k]) if above else below[:, k]
                        if p < min_covered:
                            continue
                        gain = p * (_information(p, n) - _information(wrong, good))
                        if gain > 1e-9 and (best is None or gain > best[0]):
                            best = (gain, name, above, k)
            if best is None:
                break
            _, name, above, k = best
            part = {}
            for g in (True, False):
                below = np.cumsum(counts[name, g], axis=1)
                part[g] = (below[:, -1] - below[:, k]) if above else below[:, k]
            rule.append((name, above, k))
            scored.append((*part[False], part[True][1]))
            good, wrong = part[True]
            if good:
                counts = statistics(rest & holds(rule))
        if not rule:
            break
        worth = [(p - n) / (p + n) if p + n else -1.0 for n, p, _ in scored]
        length = int(np.argmax(np.round(worth, 6))) + 1  # of equal worth the shorter rule
        n, p, grown = scored[length - 1]
        if p + grown < min_covered or p < min_precision * (p + n) or not p:
            break
        taken.append(rule[:length])
        learned.rules.append(tuple(Condition(name, above, float(cuts[name][k])) for name, above, k in rule[:length]))
    return learned
