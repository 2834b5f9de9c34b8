"""Token counts, importance resampling and whitening against plain computations."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from conftest import ODD_ROWS
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from labelweave.llm import resample, tokens, whitening
from labelweave.llm.queries import REGISTRY
from labelweave.llm.rows import ranked
from labelweave.llm.words import text_chunks

BPE = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(BPE)


def library_count(text):
    return len(TOKENIZER.encode(text or "", add_special_tokens=False).ids)


# Tokens

ODD_TEXTS = [
    "it's we'll  two   spaces\n\n\nlines\t\tx ", "<|endoftext|>", " <|endoftext|>  <|endoftext|>x", "<|endoftext", "a<|endoftext|>'s",
    "ünïcödé été 東京 ½ ٣٤   x　", "՘₏ x՘y", "\x00\x1c\x85 \x0b", "'S 'll'LL", "é" * 300, "ab" * 40_000, "   ",
]


def test_counts_of_odd_texts(spark, docs):
    rows = [*ODD_ROWS, *[(100 + i, t) for i, t in enumerate(ODD_TEXTS)]]
    got = tokens.token_counts(docs(rows), BPE).collect()
    want = Counter((i, len((t or "").encode()), library_count(t)) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want


def test_counts_when_all_tiers_are_small(monkeypatch):
    definition = open(BPE, "rb").read()
    counter = tokens.TokenCounter(definition, {"the": 1})
    counter.lengths.limit = 3
    monkeypatch.setattr(tokens, "LONG_TEXT", 5)
    for text in [*ODD_TEXTS, "the cat on the mat " * 20]:
        assert counter.count(text) == library_count(text)
    assert len(counter.lengths) <= 3 and counter.lengths["the"] == 1


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=40))
def test_counts_of_any_text(text):
    if not hasattr(test_counts_of_any_text, "counter"):
        test_counts_of_any_text.counter = tokens.TokenCounter(open(BPE, "rb").read(), {})
    assert test_counts_of_any_text.counter.count(text) == library_count(text)


def test_other_kinds_of_tokenizers_are_refused():
    with pytest.raises(ValueError):
        tokens.special_strings(open(public_tokenizers.path("word_bpe_49k.json"), "rb").read())


def test_counts_of_no_rows(docs):
    assert tokens.token_counts(docs([]), BPE).collect() == []


def test_token_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in REGISTRY["op12_two_tier_tokens"](spark, sf_dir).collect()}
    want = {r.doc_id: (len((r.text or "").encode()), library_count(r.text)) for r in rows}
    assert got == {i: (b, n, n > 512) for i, (b, n) in want.items()}


def test_counting_shuffles_nothing(spark, docs):
    plan = tokens.token_counts(docs([(1, "a b")]), BPE)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


# Resampling


def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_features(text, runs):
    w = plain_words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) for n in range(1, runs + 1) for i in range(len(w) - n + 1)]


def plain_resample(rows, target, percent, least, seed, runs=1, buckets=10_000):
    hashed = lambda texts: Counter(f % buckets for t in texts for f in plain_features(t, runs))
    s, t = hashed(r[1] for r in rows), hashed(target)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for key, text, *_ in rows:
        found = plain_features(text, runs)
        weight = sum(gain[f % buckets] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        out.append([key, len(found), weight, score, None, len(plain_words(text)) >= least])
    ready = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(ready[: percent * len(ready) // 100], 1):
        r[4] = place
    return Counter(tuple(r[:5]) for r in out)


def drawn(df):
    return Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect())


TARGET = [(1, "one two three ünï"), (2, None), (3, "w1 w2 w3")]


@pytest.mark.parametrize(("percent", "least", "runs", "buckets"), [(50, 2, 1, 10_000), (100, 0, 3, 50), (30, 1, 2, 7), (5, 3, 1, 10_000)])
def test_resampling_of_odd_rows(spark, docs, percent, least, runs, buckets):
    rows = [*ODD_ROWS, *[(50 + i % 9, f"MiXed Case{i % 3} one 12é " + "z" * (60 + i)) for i in range(40)]]
    target = spark.createDataFrame(TARGET, "item_id long, text string")
    got = resample.resample(docs(rows), target, percent=percent, least_words=least, seed=5, space=resample.FeatureSpace(runs, buckets))
    want = plain_resample(rows, [t for _, t in TARGET], percent, least, 5, runs, buckets)
    # Rows that are equal in all but their rank may swap it.
    assert drawn(got) == want


@pytest.mark.parametrize("half", [0.005, 1e-9])
def test_a_bracket_that_misses_is_widened(spark, docs, monkeypatch, half):
    monkeypatch.setattr(resample, "HALF_WIDTH", half)
    monkeypatch.setattr(resample, "SKETCH_SIZE", 8)
    rows = [(i % 700, f"a b c{i % 5}") for i in range(2_000)]
    got = resample.resample(docs(rows), spark.createDataFrame(TARGET, "item_id long, text string"), percent=37, least_words=2, seed=1)
    assert drawn(got) == plain_resample(rows, [t for _, t in TARGET], 37, 2, 1)


def test_a_third_of_equal_rows_is_drawn_and_ranked(spark, docs):
    rows = [(7, "same words here")] * 500 + [(i, f"other {i} words") for i in range(1_000)]
    got = resample.resample(docs(rows), spark.createDataFrame([], "item_id long, text string"), percent=80, least_words=1, seed=3)
    ranks = sorted(r["rank"] for r in got.collect() if r["rank"] is not None)
    assert ranks == list(range(1, 1_201))
    assert drawn(got) == plain_resample(rows, [], 80, 1, 3)


def test_resampling_of_few_or_no_rows(spark, docs):
    target = spark.createDataFrame(TARGET, "item_id long, text string")
    assert resample.resample(docs([]), target, percent=10, least_words=1, seed=1).collect() == []
    assert drawn(resample.resample(docs([(1, "a")]), target, percent=10, least_words=1, seed=1)) == plain_resample([(1, "a")], [t for _, t in TARGET], 10, 1, 1)


def test_resampling_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert drawn(REGISTRY["op13_bracketed_resampling"](spark, sf_dir)) == plain_resample(rows, target, 10, 20, 2024)


def test_checksums():
    import pyarrow as pa

    words = ["", "a", "é", "x" * 64, "y" * 65, "z" * 1000, "the"]
    (texts,) = text_chunks(pa.array(words))
    assert resample.crc_of(texts.data, texts.offsets[:-1], texts.offsets[1:]).tolist() == [zlib.crc32(w.encode()) for w in words]


def test_ranks_with_clashing_names(spark):
    df = spark.createDataFrame([(i % 5, i) for i in range(100)], "_range int, _place int")
    got = ranked(df, [F.desc("_range"), F.col("_place")], "rank").collect()
    want = sorted(((i % 5, i) for i in range(100)), key=lambda r: (-r[0], r[1]))
    assert sorted((r["rank"], r["_range"], r["_place"]) for r in got) == [(k, a, b) for k, (a, b) in enumerate(want, 1)]


# Whitening


def symmetric(seed, size, values):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q @ np.diag(values) @ q.T


@pytest.mark.parametrize(
    "matrix",
    [np.eye(5), np.zeros((4, 4)), np.ones((6, 6)), np.diag([3.0, 3, 1, 0, 0]), np.array([[0.0, 1, 0], [1, 0, 1], [0, 1, 0]]),
     symmetric(1, 30, 10.0 ** -np.arange(0, 15, 0.5)), symmetric(2, 30, [5] * 10 + [2] * 10 + [1] * 10), symmetric(3, 40, np.linspace(-3, 9, 40)),
     symmetric(4, 12, 1 + 1e-9 * np.arange(12)), np.array([[2.0]])],
)
def test_components(matrix):
    values, vectors = whitening.spectral_components(matrix)
    norm = max(np.linalg.norm(matrix), 1e-300)
    assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1], atol=1e-14 * norm, rtol=0)
    assert np.allclose(vectors.T @ vectors, np.eye(len(matrix)), atol=1e-13)
    assert np.abs(matrix @ vectors - vectors * values).max() <= 1e-14 * norm


def test_polar_factor():
    a = symmetric(5, 20, [*np.linspace(-4, -1e-9, 10), *np.linspace(1e-6, 7, 10)])
    u = whitening.polar_factor(a)
    assert np.allclose(u @ u, np.eye(20), atol=1e-12) and np.trace(u) == pytest.approx(0, abs=1e-6)


def plain_white(rows, components=16):
    """Distinct integer vectors in exact arithmetic, then the library's eigenvectors."""
    x = {i: [math.floor(64 * c) + 1_000_000 for c in v] for i, v in rows}
    fit = sorted({tuple(v) for v in x.values()})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    away = {i: [n * a - s for a, s in zip(v, sums)] for i, v in x.items()}
    centred = np.array([[(n * a - s) / n for a, s in zip(v, sums)] for v in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    white = {i: np.array(a) / n @ vectors / np.sqrt(values) for i, a in away.items()}
    return n, {i: sum(a * a for a in v) for i, v in away.items()}, white, values / np.trace(centred.T @ centred / n)


def check_white(got, rows, components):
    n, deviation, white, explained = plain_white(rows, components)
    assert {(r.vec_id, r.component) for r in got} == {(i, c) for i, _ in rows for c in range(1, components + 1)}
    signs = {}
    for r in got:
        want = white[r.vec_id][r.component - 1]
        if abs(want) > 0.1:
            signs.setdefault(r.component, set()).add(np.sign(want * r.whitened))
        assert abs(r.whitened) == pytest.approx(abs(want), abs=1e-9)
        assert (r.n, r.deviation) == (n, deviation[r.vec_id])
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-10)
        assert r.identity_error <= 1e-9
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = [(i, (rng.standard_normal(5) * [9, 5, 3, 2, 1]).tolist()) for i in range(200)]
    good += [(300 + i, good[0][1]) for i in range(100)]  # copies count once
    bad = [(900, None), (901, []), (902, [1.0, None, 2.0, 3.0, 4.0]), (903, [math.nan] * 5), (904, [math.inf, 0.0, 0.0, 0.0, 0.0]), (905, [1.0, 2.0])]
    columns = "vec_id long, embedding array<double>, x string, key string, white string, deviation int"
    df = spark.createDataFrame([(*r, "a", "b", "c", 1) for r in good + bad], columns)
    check_white(whitening.whiten(df, components=4).collect(), good, 4)
    check_white(whitening.whiten(df, components=9).collect(), good, 5)


def test_whitening_without_variance(spark):
    columns = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3 + [(None, [1.0, 2.0])]):
        assert whitening.whiten(spark.createDataFrame(rows, columns)).collect() == []
    flat = spark.createDataFrame([(None, [1.0, 5.0]), (2, [2.0, 5.0]), (3, [4.0, 5.0])], columns)  # one dimension stands still
    got = whitening.whiten(flat).collect()
    assert {(r.vec_id, r.component) for r in got} == {(None, 1), (2, 1), (3, 1)} and got[0].explained == pytest.approx(1)


def test_large_entries_stay_exact():
    x = np.array([[1 << 52, 0], [5, -(1 << 51)]])
    n = 1 << 20
    sums = np.array([3, 4])
    away = whitening.centred(x, n, sums)
    assert away.tolist() == [[n * int(a) - s for a, s in zip(row, (3, 4))] for row in x.tolist()]
    assert whitening.squared(away).to_pylist() == [None, None]
    assert whitening.squared(np.array([[3, 4], [0, 0]])).to_pylist() == [25, 0]


def test_whitening_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check_white(REGISTRY["op11_qdwh_whitening"](spark, sf_dir).collect(), rows, 16)
