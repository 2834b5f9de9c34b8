"""Mixing sources to target weights by cube-method balanced sampling.

Each source has a target number of words. A document is taken whole: every document of a source as often as
its target holds the source, and once more with the fraction that is left. That last choice is a balanced
sample: the flight phase moves the fractional inclusion probabilities of three documents at a time along the
direction that leaves the source's document and word totals as they are, until one of them is 0 or 1. It runs
in blocks; the at most two documents that a block leaves undecided move on to the next round, until one small
landing problem of at most ``LANDING_ROWS + 2`` documents is left for each source.

Defined cases: a NULL text has size 0; NULL is a source of its own, last in order; documents of size 0 take
part in document totals; rows with equal ids are separate documents; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelweave.llm.rows import bounded, fresh, numbered
from labelweave.scratch import settle

#: Documents in a block of the flight phase, on average.
BLOCK_ROWS = 4096
#: Documents that the last flight of a source leaves to the landing, to have room for a close total.
LANDING_ROWS = 12
#: Sources beyond this number raise an error: targets are computed from one row for each source.
MAX_SOURCES = 1_000_000
_SURE = 1e-9


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(
    sizes: Sequence[tuple[str | None, int]],
    weights: Sequence[float],
    *,
    share: float = 1.5,
    cap: float = 2.0,
) -> list[float]:
    """Target of each source, in the order given; ``weights`` repeat.

    ``share`` times all words are dealt by weight; a target stops at ``cap`` times its source, and what is
    above goes to the other sources by weight until none is above.
    """
    weight = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    target = [0.0] * len(sizes)
    left, free = share * sum(n for _, n in sizes), set(range(len(sizes)))
    while free:
        total = sum(weight[i] for i in sorted(free))
        level = left / total
        above = [i for i in sorted(free) if level * weight[i] > cap * sizes[i][1]]
        if not above:
            for i in free:
                target[i] = level * weight[i]
            break
        for i in above:
            target[i] = cap * sizes[i][1]
            left -= target[i]
            free.discard(i)
    return target


def flight(probability: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move probabilities to 0 or 1, keeping their sum and their sum of sizes; at most two stay between.

    Documents are taken in the order given, so the ones left over are the last.
    """
    p = probability.astype(float).tolist()
    s = size.astype(float).tolist()
    draws = rng.random(len(p) + 3).tolist()
    step = 0
    open_ = [i for i in range(len(p)) if _SURE < p[i] < 1 - _SURE][::-1]
    held: list[int] = []
    while True:
        while len(held) < 3 and open_:
            held.append(open_.pop())
        if len(held) < 2 or (len(held) == 2 and s[held[0]] != s[held[1]]):
            break
        if len(held) == 3:
            a, b, c = held
            u = (s[b] - s[c], s[c] - s[a], s[a] - s[b])
            if not any(u):
                u = (1.0, -1.0, 0.0)
        else:
            u = (1.0, -1.0)
        up = min((1 - p[i]) / x if x > 0 else -p[i] / x for i, x in zip(held, u) if x)
        down = min(p[i] / x if x > 0 else (p[i] - 1) / x for i, x in zip(held, u) if x)
        move = up if draws[step % len(draws)] * (up + down) < down else -down
        step += 1
        for i, x in zip(held, u):
            p[i] += move * x
            if p[i] <= _SURE:
                p[i] = 0.0
            elif p[i] >= 1 - _SURE:
                p[i] = 1.0
        held = [i for i in held if 0 < p[i] < 1]
    return np.array(p)


def landing(probability: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decide the few documents left: of all choices the one nearest to the expected words and documents.

    A document counts as much as the words of a mean one; of equal choices the first is taken.
    """
    out = probability.copy()
    open_ = np.flatnonzero((out > 0) & (out < 1))
    if len(open_):
        choices = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
        scale = max(1.0, float(size[open_].mean()))
        words = np.abs(choices @ size[open_] - out[open_] @ size[open_]) / scale
        rows = np.abs(choices.sum(axis=1) - out[open_].sum())
        out[open_] = choices[np.argmin(words + np.maximum(rows - 1, 0))]
    return out


def _fly(last: bool, seed: int):
    """Flight over the rows of one block, largest documents first; ``last`` adds the landing."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rank, block, level = (k.as_py() for k in key)
        size = table["size"].to_numpy()
        order = np.lexsort((table["_row"].to_numpy(), table["_tie"].to_numpy(), -size))
        p = table["_p"].to_numpy()[order].copy()
        moving = np.ones(len(p), bool)
        if last:
            moving[np.argsort(table["_tie"].to_numpy()[order], kind="stable")[:LANDING_ROWS]] = False
        p[moving] = flight(p[moving], size[order][moving], np.random.default_rng([seed, rank, block, level]))
        if last:
            p = landing(p, size[order])
        back = np.empty_like(p)
        back[order] = p
        return pa.table({"_row": table["_row"], "_rank": table["_rank"], "size": table["size"], "_tie": table["_tie"], "_p": back})

    return run


_FLOWN = "_row long, _rank int, size long, _tie long, _p double"


def balanced_sample(rows: DataFrame, *, seed: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(_row, _chosen) for rows (_row, _rank, size, _tie, _p): 0 or 1 with expectation ``_p``.

    Balanced within each ``_rank`` on the sums of ``_p`` and of ``size * _p``. Blocks are even: rows are
    dealt by ``_tie``, the number of blocks follows the rows of the rank, so a hot rank has many blocks.
    """
    decided = rows.filter((F.col("_p") <= _SURE) | (F.col("_p") >= 1 - _SURE)).select(
        "_row", F.round("_p").cast("int").alias("_chosen")
    )
    open_ = settle(rows.filter((F.col("_p") > _SURE) & (F.col("_p") < 1 - _SURE)), "open")
    level = 0
    while True:
        # A narrow row for each source with open rows.
        blocks = settle(open_.groupBy("_rank").agg(F.ceil(F.count("*") / block_rows).alias("_blocks")), "blocks")
        most = blocks.agg(F.max("_blocks")).first()[0]
        if not most:
            return decided
        last = most == 1
        by_block = F.pmod(F.xxhash64("_tie", F.lit(level)), F.col("_blocks")).cast("int")
        dealt = open_.join(bounded(blocks), "_rank").withColumn("_block", by_block).drop("_blocks")
        flown = settle(
            dealt.withColumn("_level", F.lit(level)).groupBy("_rank", "_block", "_level").applyInArrow(_fly(last, seed), _FLOWN),
            "flown",
        )
        done = (F.col("_p") == 0) | (F.col("_p") == 1)
        decided = decided.unionByName(flown.filter(done).select("_row", F.col("_p").cast("int").alias("_chosen")))
        if last:
            return decided
        open_ = flown.filter(~done)
        level += 1


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float],
    *,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    row: str | None = None,
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 0,
) -> DataFrame:
    """(_row, doc_id, size, source_size, target, copies, taken) for each row of ``docs``.

    Texts are read once; what is stored and shuffled is narrow. ``row`` names a column that numbers the rows;
    without it they are numbered as they are read.
    """
    size = word_count(docs[text])
    stored = settle(
        docs.select(
            (docs[row] if row else F.monotonically_increasing_id()).alias("_row"),
            docs[key].alias("doc_id"),
            docs[source].cast("string").alias("_source"),
            size.alias("size"),
            # Blocks and draws follow the document, not its place in the files.
            F.xxhash64(docs[key].cast("string"), docs[source].cast("string"), size).alias("_tie"),
        ),
        "sizes",
    )
    spark = stored.sparkSession
    sources = stored.groupBy("_source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(sources) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = sorted(((r["_source"], r["n"]) for r in sources), key=lambda x: (x[0] is None, x[0] or ""))
    targets = source_targets(sizes, weights, share=share, cap=cap)
    plan = []
    for rank, ((name, n), target) in enumerate(zip(sizes, targets)):
        times = min(target / n if n else 0.0, cap)
        # A rest that is a rounding error of the division is no fraction.
        whole = math.floor(times + _SURE)
        plan.append((name, rank, n, target, whole, max(0.0, times - whole)))
    schema = T.StructType(
        [
            T.StructField("_name", T.StringType()),
            T.StructField("_rank", T.IntegerType()),
            T.StructField("source_size", T.LongType()),
            T.StructField("target", T.DoubleType()),
            T.StructField("_whole", T.IntegerType()),
            T.StructField("_p", T.DoubleType()),
        ]
    )
    planned = F.broadcast(spark.createDataFrame(plan, schema))  # at most MAX_SOURCES narrow rows
    rows = stored.join(planned, F.col("_source").eqNullSafe(F.col("_name")))
    chosen = balanced_sample(rows.select("_row", "_rank", "size", "_tie", "_p"), seed=seed)
    copies = F.col("_whole") + F.col("_chosen")
    return rows.join(chosen, "_row").select(
        "_row",
        "doc_id",
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, weights: Sequence[float], **options) -> DataFrame:
    """``docs`` as the mix takes them: rows left out are gone, rows taken twice occur twice.

    The rows are stored once with a row number, so that the choice is joined to the rows it was made for.
    """
    row = fresh(docs, "_row")
    stored = numbered(docs, row)
    mix = mix_sources(stored, weights, row=row, **options).filter("copies > 0")
    taken = mix.select(F.col("_row").alias(row), F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("_one"))
    return stored.join(bounded(settle(taken.drop("_one"), "taken")), row).select(*docs.columns)
