"""URL filters by Bloom filter cascades.

A cascade answers "is this key listed?" exactly for every key of a known universe. Level 0 is a Bloom filter
of the listed keys; level 1 holds the keys of the universe that level 0 accepts wrongly; level 2 the listed
keys that level 1 accepts wrongly, and so on until no wrong key is left. The first level that refuses a key
decides. The filters are constant arrays of 64-bit words inside the expression, so judging needs no join.

Their size follows the list and the logarithm of the universe, not the pages. A list whose first filter would be
beyond ``MAX_WORDS`` words (16 MB, about ten million keys) is dealt by key hash into several cascades, so that no
array is larger; all of them together take some 12 bits for each listed key.

Of a host's parents only those with as many labels as some listed key are looked at, so a host of thousands of
labels costs a few strings.

Defined cases: a NULL url or one without ``://`` has an empty host and path, fits no rule and is allowed;
repeated urls are judged row by row; with an empty list a cascade contains nothing; all other columns of the
pages stay, whatever their names, but for host, path, rule and verdict, which are replaced.
"""

from __future__ import annotations

import math
import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.llm.rows import fresh
from labelweave.scratch import settle

#: Words of a filter's array.
MAX_WORDS = 1 << 21


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or end, with ASCII letters in lower case."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_suffixes(host: Column, labels: Sequence[int]) -> Column:
    """The ends of the host that have one of the given numbers of labels, longest first; nothing for an empty host."""
    own = F.length(host) - F.length(F.replace(host, F.lit("."))) + 1
    counts = F.array(*[F.lit(n) for n in sorted(set(labels), reverse=True)]).cast("array<int>")
    ends = F.transform(
        F.filter(counts, lambda n: n <= own), lambda n: F.call_function("substring_index", host, F.lit("."), -n)
    )
    return F.when(host != "", ends).otherwise(F.array().cast("array<string>"))


def label_counts(domains: DataFrame) -> list[int]:
    """Numbers of labels that the keys of a list have."""
    labels = F.length("key") - F.length(F.replace(F.col("key"), F.lit("."))) + 1
    return sorted(r[0] for r in domains.select(labels).distinct().collect() if r[0] is not None)


def candidate_keys(host: Column, path: Column, lengths: Sequence[int], labels: Sequence[int]) -> Column:
    """Every (end of the host) + (start of the path, of one of the lengths), the longest key first.

    Of keys of one length, the one with the longer host comes first.
    """
    starts = [
        F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(set(lengths), reverse=True)
    ]
    pairs = F.flatten(
        F.transform(
            host_suffixes(host, labels),
            lambda h: F.transform(
                F.filter(F.array(*starts), lambda p: p.isNotNull()),
                lambda p: F.struct(
                    (-F.length(h) - F.length(p)).alias("rank"), (-F.length(h)).alias("host"), F.concat(h, p).alias("key")
                ),
            ),
        )
    )
    return F.transform(F.array_sort(pairs), lambda x: x["key"])


@dataclass
class BloomLevel:
    """One filter: its words as a constant array, and its parameters."""

    words: Column | None
    bits: int
    hashes: int
    seed: int

    @classmethod
    def of(cls, keys: DataFrame, count: int, rate: float, seed: int) -> BloomLevel:
        """Filter of the column ``key`` with about the given rate of wrong answers."""
        hashes, n_words = cls.measures(count, rate)
        level = cls(None, n_words * 64, hashes, seed)
        set_bits = keys.select(F.explode(level._positions(F.col("key"))).alias("bit"))
        rows = set_bits.groupBy(F.expr("bit div 64").alias("at")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("word")
        )
        words = [0] * n_words
        for row in rows.collect():  # at most n_words rows
            words[row["at"]] = row["word"]
        # One string that the optimizer folds into one constant array.
        level.words = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")
        return level

    @staticmethod
    def measures(count: int, rate: float) -> tuple[int, int]:
        """Hash functions and words of a filter."""
        hashes = max(1, round(math.log2(1 / rate)))
        return hashes, -(-math.ceil(count * hashes / math.log(2)) // 64)

    def _positions(self, key: Column) -> Column:
        """Bit numbers of a key by double hashing."""
        bits = F.lit(self.bits).cast("long")
        first = F.pmod(F.xxhash64(key, F.lit(2 * self.seed)), bits)
        step = F.pmod(F.xxhash64(key, F.lit(2 * self.seed + 1)), bits)
        numbers = F.array(*[F.lit(i).cast("long") for i in range(self.hashes)])
        return F.transform(numbers, lambda i: F.pmod(first + step * i, bits))

    def accepts(self, key: Column) -> Column:
        return F.forall(
            self._positions(key),
            lambda bit: F.getbit(
                F.element_at(self.words, (F.shiftright(bit, 6) + 1).cast("int")), bit.bitwiseAND(63).cast("int")
            )
            == 1,
        )


@dataclass
class Cascade:
    levels: list[BloomLevel]

    def contains(self, key: Column) -> Column:
        """Exact for keys of the universe that the cascade was built over."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for at in reversed(range(len(self.levels))):
            answer = F.when(self.levels[at].accepts(key), answer).otherwise(F.lit(at % 2 == 1))
        return answer


@dataclass
class DealtCascade:
    """Cascades over the parts of the keys that a hash deals out."""

    parts: list[Cascade]

    @staticmethod
    def part_of(key: Column, parts: int) -> Column:
        return F.pmod(F.xxhash64(F.lit("part"), key), F.lit(parts))

    def contains(self, key: Column) -> Column:
        """Exact for keys of the universe that the cascades were built over."""
        at = self.part_of(key, len(self.parts))
        answer = F.lit(False)
        for i, part in enumerate(self.parts):
            answer = F.when(at == i, part.contains(key)).otherwise(answer)
        return answer


def build_cascade(listed: DataFrame, universe: DataFrame, *, max_levels: int = 64) -> Cascade | DealtCascade:
    """Cascade of the keys of ``listed`` that is exact over ``universe`` (both: distinct, column ``key``).

    Listed keys outside the universe take part too. A list that is too long for one array is dealt into parts.
    """
    inside = settle(listed.select("key").distinct(), "listed")
    outside = universe.select("key").join(inside, "key", "left_anti")
    n_inside, n_outside = inside.count(), outside.count()
    _, words = BloomLevel.measures(n_inside, _first_rate(n_inside, n_outside))
    parts = -(-words // MAX_WORDS)
    if parts <= 1:
        return _cascade(inside, outside, n_inside, n_outside, max_levels)
    stored = settle(outside, "outside")
    dealt = []
    for i in range(parts):
        mine = DealtCascade.part_of(F.col("key"), parts) == i
        some, others = inside.filter(mine), stored.filter(mine)
        dealt.append(_cascade(some, others, some.count(), others.count(), max_levels))
    return DealtCascade(dealt)


def _first_rate(n_inside: int, n_outside: int) -> float:
    """Leaves about as many wrong keys as there are listed ones."""
    return min(0.5, max(1, n_inside) * math.sqrt(0.5) / max(1, n_outside))


def _cascade(inside: DataFrame, outside: DataFrame, n_inside: int, n_outside: int, max_levels: int) -> Cascade:
    """Each level is one pass over the side it has to refuse; the sides shrink by the rate of the level before."""
    levels: list[BloomLevel] = []
    while n_inside:
        if len(levels) == max_levels:
            raise RuntimeError("the cascade does not end: a key is listed and not listed")
        rate = 0.5 if levels else _first_rate(n_inside, n_outside)
        level = BloomLevel.of(inside, n_inside, rate, len(levels))
        levels.append(level)
        if not n_outside:
            break
        wrong = settle(outside.filter(level.accepts(F.col("key"))), "accepted")
        inside, outside = wrong, inside
        n_inside, n_outside = wrong.count(), n_inside
    return Cascade(levels)


@dataclass(frozen=True)
class UrlRules:
    """Rules as host + start of the path; the longest that fits wins, of equally long ones the longer host."""

    block: tuple[str, ...]
    allow: tuple[str, ...]

    def path_lengths(self) -> list[int]:
        return sorted({len(r) - r.index("/") for r in [*self.block, *self.allow]})

    def label_counts(self) -> list[int]:
        return sorted({r[: r.index("/")].count(".") + 1 for r in [*self.block, *self.allow]})


def judge_urls(pages: DataFrame, rules: UrlRules, domains: DataFrame, *, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict (replacing columns of these names).

    ``domains`` (column ``key``) is a block list: a url that no rule fits is blocked if its host or a parent
    of it is listed. The universe of the cascades is every key of every url that is looked up; it is stored once
    and read by each level.
    """
    spark = pages.sparkSession
    host, path = host_of(pages[url]), path_of(pages[url])
    candidates = candidate_keys(host, path, rules.path_lengths(), rules.label_counts())
    named = settle(domains.select("key"), "domains")
    parents = host_suffixes(host, label_counts(named))
    universe = settle(
        pages.select(F.explode(F.concat(candidates, parents)).alias("key")).distinct(), "universe"
    )
    given = lambda keys: spark.createDataFrame([(k,) for k in keys], "key string")
    block, allow = build_cascade(given(rules.block), universe), build_cascade(given(rules.allow), universe)
    listed = build_cascade(named, universe)
    keys, ends, blocked, allowed, on_list = (
        fresh(pages, name) for name in ("_keys", "_ends", "_blocked", "_allowed", "_on_list")
    )

    def longest(cascade: Cascade | DealtCascade) -> Column:
        return F.try_element_at(F.filter(keys, cascade.contains), F.lit(1))

    keyed = pages.select(
        *[pages[c] for c in pages.columns if c.lower() not in {"host", "path", "rule", "verdict"}],
        host.alias("host"),
        path.alias("path"),
        candidates.alias(keys),
        parents.alias(ends),
    )
    found = keyed.withColumns(
        {blocked: longest(block), allowed: longest(allow), on_list: F.exists(ends, listed.contains)}
    )
    at = lambda c: F.coalesce(F.nullif(F.array_position(keys, F.col(c)), F.lit(0)), F.lit(1 << 30))
    rule = F.when(at(blocked) < at(allowed), F.col(blocked)).otherwise(F.col(allowed))
    verdict = (
        F.when(rule.isNull(), F.when(F.col(on_list), "block").otherwise("allow"))
        .when(at(blocked) < at(allowed), "block")
        .otherwise("allow")
    )
    return found.withColumns({"rule": rule, "verdict": verdict}).drop(keys, ends, blocked, allowed, on_list)
