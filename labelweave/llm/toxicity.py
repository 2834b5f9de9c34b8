"""Toxicity by classifier chains.

Categories are predicted one after the other. A category's linear model sees the text and the probabilities of
the categories before it; in training these are out-of-fold predictions, so a later model learns from
probabilities as uncertain as the ones it will meet. A category's threshold is the one with the best F1 on its
out-of-fold predictions.

Text features are the words of a document and the first letters of its words, each counted once: all that
``MIN_DOCUMENTS`` documents of the sample have, however many these are. Models are logistic regressions
whose features are scaled by their log odds in the training rows; the fits of one category (one without each fold
and one on all rows) run as parallel tasks, each in a partition of its own that holds the rows it sees. They see a bounded sample of labelled rows (``max_rows``). Scoring
covers every row, without a shuffle.

Defined cases: a NULL or empty text has no features and gets the score of the intercept; rows without a label of
a category take no part in its training; a category with one class in the sample gets that class's share as
constant probability; without labelled rows the probability is 0 and nothing is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.llm.rows import arrow_rows, fresh, release
from labelweave.llm.words import Texts, find_words, mix, span_hashes, text_chunks, word_hashes
from labelweave.scratch import settle

#: Letters at the start of a word that are a feature of their own.
START_LETTERS = 4
#: Documents of the sample that must have a term of the model.
MIN_DOCUMENTS = 3
#: Labelled rows that models are fitted on, on average; fewer if there are fewer.
MAX_ROWS = 20_000
FOLDS = 3
#: Term places that a fit handles at a time.
BLOCK_PLACES = 1 << 18
#: Rows that the training steps hand to Python at a time.
BATCH_ROWS = 1_000


def letters(text: Column) -> Column:
    """The text in lower case, with one space for all that is no letter."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " ")


def text_terms(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each word and of each word's start."""
    words = find_words(texts)
    heads = np.flatnonzero((texts.data & 0xC0) != 0x80)  # first byte of each code point
    after = np.searchsorted(heads, words.starts) + START_LETTERS
    ends = np.append(heads, len(texts.data))[np.minimum(after, len(heads))]
    starts = mix(span_hashes(texts.data, words.starts, np.minimum(ends, words.ends)), 9)
    return np.concatenate([words.doc, words.doc]), np.concatenate([word_hashes(texts, words), starts])


def _term_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All columns but the text, and the distinct term hashes."""
    for batch in batches:
        for texts in text_chunks(batch.column(batch.num_columns - 1)):
            doc, terms = text_terms(texts)
            doc, terms = distinct_pairs(doc, terms)
            offsets = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(terms.view(np.int64)))
            rest = [c.slice(texts.first, len(texts)) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*rest, lists], [*batch.schema.names[:-1], "terms"])
    release()


def distinct_pairs(doc: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text, term) pairs, ordered."""
    order = np.lexsort((terms, doc))
    doc, terms = doc[order], terms[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (terms[1:] != terms[:-1])
    return doc[new], terms[new]


def vocabulary_ids(doc: np.ndarray, terms: np.ndarray, vocabulary: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct vocabulary places of each row: bounds (one more than rows) and places."""
    if not len(vocabulary) or not len(terms):
        return np.zeros(rows + 1, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
    hit = vocabulary[at] == terms
    pairs = np.unique(doc[hit] * len(vocabulary) + at[hit])
    return np.searchsorted(pairs, np.arange(rows + 1) * len(vocabulary)), pairs % len(vocabulary)


def _blocks(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last row of runs with about ``BLOCK_PLACES`` places."""
    edges = np.searchsorted(bounds, np.arange(BLOCK_PLACES, bounds[-1], BLOCK_PLACES))
    edges = np.unique([0, *edges, len(bounds) - 1])
    return zip(edges[:-1], edges[1:])


def row_sums(weights: np.ndarray, bounds: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Sum of the weights of each row's places."""
    out = np.zeros(len(bounds) - 1)
    for a, b in _blocks(bounds):
        at = bounds[a : b + 1] - bounds[a]
        sums = np.concatenate([[0.0], np.cumsum(weights[ids[bounds[a] : bounds[b]]])])
        out[a:b] = sums[at[1:]] - sums[at[:-1]]
    return out


def place_sums(values: np.ndarray, bounds: np.ndarray, ids: np.ndarray, size: int) -> np.ndarray:
    """Sum of the values of the rows that have each place."""
    out = np.zeros(size)
    for a, b in _blocks(bounds):
        each = np.repeat(values[a:b], np.diff(bounds[a : b + 1]))
        out += np.bincount(ids[bounds[a] : bounds[b]], weights=each, minlength=size)
    return out


@dataclass
class LinearModel:
    """Weights of the vocabulary, of the earlier probabilities, and an intercept."""

    weights: np.ndarray
    earlier: np.ndarray
    intercept: float

    def probability(self, bounds: np.ndarray, ids: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        margin = row_sums(self.weights, bounds, ids) + earlier @ self.earlier + self.intercept
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def _minimize(value_and_slope, start: np.ndarray, steps: int = 25, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with step halving."""
    x, (value, slope) = start, value_and_slope(start)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, kept = slope.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (s @ y)
            q -= a * y
            kept.append(a)
        q *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, np.linalg.norm(slope))
        for (s, y), a in zip(pairs, reversed(kept)):
            q += (a - (y @ q) / (s @ y)) * s
        rate, fall = 1.0, slope @ q
        while rate > 1e-6:
            tried = value_and_slope(x - rate * q)
            if tried[0] <= value - 1e-4 * rate * fall:
                break
            rate /= 2
        else:
            break
        moved, turned = -rate * q, tried[1] - slope
        done = value - tried[0] < 1e-7 * max(1.0, abs(value))
        x, (value, slope) = x + moved, tried
        if done:
            break
        if moved @ turned > 1e-12:
            pairs = [*pairs, (moved, turned)][-memory:]
    return x


def fit_linear(
    bounds: np.ndarray, ids: np.ndarray, earlier: np.ndarray, y: np.ndarray, size: int, reg: float
) -> LinearModel:
    """Logistic regression on log-odds scaled terms and the earlier probabilities."""
    n, k = len(y), earlier.shape[1]
    if not n or y.min() == y.max():
        share = float(y.mean()) if n else 0.0
        margin = np.inf if share == 1 else -np.inf
        return LinearModel(np.zeros(size), np.zeros(k), margin)
    positive, negative = (place_sums(v, bounds, ids, size) for v in (y, 1 - y))
    scale = np.log((positive + 1) / (y.sum() + 2)) - np.log((negative + 1) / (n - y.sum() + 2))

    def value_and_slope(x: np.ndarray) -> tuple[float, np.ndarray]:
        margin = row_sums(x[:size] * scale, bounds, ids) + earlier @ x[size:-1] + x[-1]
        loss = np.logaddexp(0, margin) - y * margin
        off = (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - y) / n
        slope = np.concatenate([scale * place_sums(off, bounds, ids, size), off @ earlier, [off.sum()]])
        slope[:-1] += reg * x[:-1]
        return loss.mean() + reg / 2 * float(x[:-1] @ x[:-1]), slope

    start = np.zeros(size + k + 1)
    start[-1] = np.log(y.mean() / (1 - y.mean()))
    x = _minimize(value_and_slope, start)
    return LinearModel(x[:size] * scale, x[size:-1], float(x[-1]))


def _id_batches(vocabulary: np.ndarray):
    """The last column, distinct term hashes, as places in the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            flat = lists.flatten().to_numpy().view(np.uint64)
            doc = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            bounds, ids = vocabulary_ids(doc, flat, vocabulary, len(lists))
            encoded = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], encoded], [*batch.schema.names[:-1], "ids"])
        release()

    return run


_FITTED = "model int, weights binary"


def _lists(batches: Sequence[pa.RecordBatch], name: str) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of a list column."""
    columns = [b.column(name) for b in batches]
    sizes = [np.diff(c.offsets.to_numpy()) for c in columns]
    return np.concatenate(sizes).astype(np.int64), np.concatenate([c.flatten().to_numpy() for c in columns])


def _fit_batches(size: int, places: int, reg: float):
    """One model from all rows of a partition; rows are put in order, so that sums do not follow the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = [b for b in batches if b.num_rows]
        if not given:
            return
        model = given[0].column("model")[0].as_py()
        order = np.argsort(np.concatenate([b.column("row").to_numpy() for b in given]))
        y = np.concatenate([b.column("y").to_numpy() for b in given])[order]
        _, earlier = _lists(given, "earlier")
        counts, ids = _lists(given, "ids")
        given.clear()
        earlier = earlier.reshape(len(y), places)[order]
        bounds = np.concatenate([[0], np.cumsum(counts)])
        ids = np.concatenate([ids[bounds[i] : bounds[i + 1]] for i in order])
        bounds = np.concatenate([[0], np.cumsum(counts[order])])
        fitted = fit_linear(bounds, ids, earlier, y, size, reg)
        packed = np.concatenate([fitted.weights, fitted.earlier, [fitted.intercept]])
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.int32()), pa.array([packed.tobytes()])], ["model", "weights"])
        release()

    return run


def _held_batches(models: dict[int, LinearModel], places: int):
    """Rows with the probability of their own fold's model, which has not seen them, added to the earlier ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, ids = _lists([batch], "ids")
            _, earlier = _lists([batch], "earlier")
            rows, fold = len(counts), batch.column("fold").to_numpy()
            earlier = earlier.reshape(rows, places)
            bounds = np.concatenate([[0], np.cumsum(counts)])
            p = np.zeros(rows)
            for f, model in models.items():
                mine = fold == f
                p[mine] = model.probability(*_rows(bounds, ids, mine), earlier[mine])
            wide = np.column_stack([earlier, p])
            offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * wide.shape[1])
            lists = pa.ListArray.from_arrays(offsets, pa.array(wide.ravel()))
            columns = [lists if n == "earlier" else batch.column(n) for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)
        release()

    return run


def _rows(bounds: np.ndarray, ids: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = np.diff(bounds)
    return np.concatenate([[0], np.cumsum(counts[keep])]), ids[np.repeat(keep, counts)]


def best_threshold(rows: DataFrame, label: str, probability: str, steps: int = 40) -> float:
    """Threshold of the grid with the best F1; the middle one of equally good ones."""
    grid = [(i + 0.5) / steps for i in range(steps)]
    hit = [F.sum(F.when((F.col(probability) >= t), F.col(label)).otherwise(0.0)) for t in grid]
    said = [F.sum((F.col(probability) >= t).cast("double")) for t in grid]
    found = rows.select(F.sum(label), *hit, *said).first()
    positive = found[0] or 0.0
    scores = [
        round(2 * (found[1 + i] or 0.0) / ((found[1 + steps + i] or 0.0) + positive), 9) if positive else 0.0
        for i in range(steps)
    ]
    best = [t for t, s in zip(grid, scores) if s == max(scores)]
    return best[len(best) // 2] if positive else 1.1


@dataclass
class ClassifierChain:
    """Models in the order of their categories, a threshold for each, and the hashes of the vocabulary."""

    categories: list[str]
    vocabulary: np.ndarray
    models: list[LinearModel] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)

    def probabilities(self, df: DataFrame, text: str, names: Sequence[str]) -> DataFrame:
        """``df`` with a probability column for each category, named by ``names``."""
        name = fresh(df, "_letters")
        columns = df.columns
        schema = df.select(*columns).schema
        for p in names:
            schema = schema.add(p, "double")
        ready = df.withColumn(name, letters(F.col(text)))
        return ready.mapInArrow(_score_batches(self, list(names)), schema)


def _score_batches(chain: ClassifierChain, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for texts in text_chunks(batch.column(batch.num_columns - 1)):
                bounds, ids = vocabulary_ids(*text_terms(texts), chain.vocabulary, len(texts))
                p = np.zeros((len(texts), 0))
                for model in chain.models:
                    p = np.column_stack([p, model.probability(bounds, ids, p)])
                parts.append(p)
            p = np.concatenate(parts) if parts else np.zeros((0, len(names)))
            columns = [*batch.columns[:-1], *(pa.array(p[:, i]) for i in range(len(names)))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], *names])
        release()

    return run


def fit_chain(
    labelled: DataFrame,
    categories: Sequence[str],
    *,
    key: str = "doc_id",
    text: str = "text",
    max_rows: int = MAX_ROWS,
    folds: int = FOLDS,
    reg: float = 1e-3,
    seed: int = 0,
) -> ClassifierChain:
    """Chain over 0/1 label columns, in the order given.

    The sample and the folds follow a hash of the key, so reruns and other partitionings take the same rows.
    The driver gets the vocabulary and ``folds`` + 1 weight vectors of one category at a time.
    """
    n = labelled.select(key).count()
    share = min(1.0, max_rows / n) if n else 1.0
    digest = F.xxhash64(F.col(key), F.lit(seed))
    sample = labelled.filter(F.pmod(digest, F.lit(1_000_003)) < share * 1_000_003)
    labels = [F.col(c).cast("double").alias(f"y{i}") for i, c in enumerate(categories)]
    rows = sample.select(
        F.monotonically_increasing_id().alias("row"),
        F.pmod(F.shiftright(digest, 20), F.lit(folds)).cast("int").alias("fold"),
        *labels,
        letters(F.col(text)).alias("text"),
    )
    spark = labelled.sparkSession
    schema = "row long, fold int, " + "".join(f"y{i} double, " for i in range(len(categories))) + "terms array<long>"
    with arrow_rows(spark, BATCH_ROWS):
        rows = settle(rows.mapInArrow(_term_batches, schema), "training")
    found = (
        rows.select(F.explode("terms").alias("term"))
        .groupBy("term")
        .count()
        .filter(F.col("count") >= MIN_DOCUMENTS)
        .select("term")
        .toArrow()
    )
    chain = ClassifierChain(list(categories), np.sort(found["term"].to_numpy().view(np.uint64)))
    size = len(chain.vocabulary)
    encoded = rows.mapInArrow(_id_batches(chain.vocabulary), schema.replace("terms array<long>", "ids array<int>"))
    with arrow_rows(spark, BATCH_ROWS):
        told = settle(encoded.withColumn("earlier", F.array().cast("array<double>")), "encoded")
    for i in range(len(categories)):
        # Model ``folds`` sees all rows, each other one the rows outside its own fold.
        every = F.sequence(F.lit(0), F.lit(folds))
        seen = F.explode(F.filter(every, lambda m: m != F.col("fold"))).alias("model")
        ready = told.filter(F.col(f"y{i}").isNotNull()).select(seen, "row", F.col(f"y{i}").alias("y"), "ids", "earlier")
        fits = ready.repartitionById(folds + 1, "model").mapInArrow(_fit_batches(size, i, reg), _FITTED)
        with arrow_rows(spark, BATCH_ROWS):
            models = {r["model"]: _unpacked(r["weights"], size) for r in settle(fits, "fitted").collect()}
        blank = LinearModel(np.zeros(size), np.zeros(i), -np.inf)
        chain.models.append(models.get(folds, blank))
        if folds not in models:
            chain.thresholds.append(1.1)
            continue
        held = {f: models.get(f, blank) for f in range(folds)}
        told = settle(told.mapInArrow(_held_batches(held, i), told.schema), "folds")
        scored = told.select(f"y{i}", F.element_at("earlier", i + 1).alias("p")).filter(F.col(f"y{i}").isNotNull())
        chain.thresholds.append(best_threshold(scored, f"y{i}", "p"))
    return chain


def _unpacked(weights: bytes, size: int) -> LinearModel:
    values = np.frombuffer(weights, float)
    return LinearModel(values[:size], values[size:-1], float(values[-1]))


def score_documents(docs: DataFrame, chain: ClassifierChain, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, p_<category> for each category, and the last category's verdict by its name)."""
    names = [f"p_{c}" for c in chain.categories]
    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))
    scored = chain.probabilities(rows, "text", names).drop("text")
    return scored.withColumn(chain.categories[-1], F.col(names[-1]) >= chain.thresholds[-1])


def keep_clean(docs: DataFrame, chain: ClassifierChain, *, text: str = "text") -> DataFrame:
    """``docs`` without the rows that the last category's model rejects; all columns stay."""
    names: list[str] = []
    for i in range(len(chain.categories)):
        names.append(fresh(docs, f"_p{i}"))
    scored = chain.probabilities(docs, text, names)
    return scored.filter(F.col(names[-1]) < chain.thresholds[-1]).select(*docs.columns)
