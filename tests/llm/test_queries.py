"""The registered queries over the tables of sf0.001, and the pipeline over a small table with planted cases."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_operators import plain_classes, plain_repeats, words
from test_words import plain_counts

import corpus_pipeline
from __spark_entry__ import queries
from labelweave.llm.mixing import source_targets
from labelweave.llm.queries import REGISTRY, SOURCE_WEIGHTS


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def rows_of(spark, sf_dir, name):
    return {r["doc_id"]: r.asDict() for r in REGISTRY[name](spark, sf_dir).collect()}


def test_one_query_for_each_operator():
    names = [n for n in queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert queries()["pipeline"] is corpus_pipeline.run


def test_repeats_query(spark, sf_dir, documents):
    got = rows_of(spark, sf_dir, "op2_suffix_repeats")
    want = plain_repeats([(i, t) for i, t, _ in documents], 20)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted((str(i), r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in got.items()) == [
        (i, n, gone, digest(kept)) for i, n, gone, kept in want
    ]


def test_near_duplicate_query(spark, sf_dir, documents):
    got = rows_of(spark, sf_dir, "op4_order_minhash")
    roots = plain_classes([(i, t) for i, t, _ in documents])
    first = {}
    for (i, _, _), root in zip(documents, roots):
        first[root] = min(first.get(root, i), i)
    assert {i: r["class_id"] for i, r in got.items()} == {i: first[root] for (i, _, _), root in zip(documents, roots)}


def test_rules_query(spark, sf_dir, documents):
    got = rows_of(spark, sf_dir, "op5_decision_list")
    for i, t, _ in documents:
        want = plain_counts(t)
        assert {n: got[i][n] for n in want} == want
        failed = want["n_words"] < 10 or 100 * want["n_repeat_words"] > 20 * want["n_words"]
        assert got[i]["base_failed"] == failed and not (failed and got[i]["kept"])


def test_mix_query(spark, sf_dir, documents):
    got = rows_of(spark, sf_dir, "op6_cube_mix")
    sizes = Counter()
    for i, t, s in documents:
        assert got[i]["size"] == len(words(t)) and got[i]["taken"] in (0, got[i]["size"], 2 * got[i]["size"])
        sizes[s] += len(words(t))
    ordered = sorted(sizes.items())
    targets = dict(zip((s for s, _ in ordered), source_targets(ordered, SOURCE_WEIGHTS)))
    for i, _, s in documents:
        assert got[i]["source_size"] == sizes[s] and got[i]["target"] == pytest.approx(targets[s])


def test_toxicity_query_on_labels(spark, sf_dir):
    got = rows_of(spark, "/root/testdata/sf0.01", "op7_toxicity_chain")
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    wrong = sum(got[r.doc_id]["toxic"] != (r.toxic == 1) for r in marks)
    assert len(got) == 1000 and wrong <= 0.05 * len(marks)


def plain_rows():
    rng = np.random.default_rng(11)
    pool = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnrst"]
    rows, marks = [], []
    for i in range(240):
        w = list(rng.choice(pool, size=int(rng.integers(15, 70))))
        toxic = i % 6 == 0
        if toxic:
            w.insert(3, "vilezork")
        rows.append([i, " ".join(w), "en", f"src{i % 3}", 0])
        if i < 200:
            marks.append((i, 1, int(toxic)))
    for i in range(20):  # exact and near copies of clean documents
        rows.append([1000 + i, rows[6 * i + 1][1], "en", "src0", 0])
        edited = rows[6 * i + 2][1].split() + ["extra"]
        rows.append([2000 + i, " ".join(edited), "en", "src1", 0])
    rows += [[3000, None, None, None, None], [3001, "", "en", "src2", 0]]
    return rows, marks


def test_pipeline(spark, tmp_path):
    rows, marks = plain_rows()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    spark.createDataFrame(marks, "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, {}
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert at == 4 or docs.columns == columns
        kept[name] = [r.asDict() for r in docs.collect()]
    ids = lambda name: [r["doc_id"] for r in kept[name]]
    clean = [r for r in rows if "vilezork" not in (r[1] or "")]
    assert sorted(ids("toxicity")) == sorted(r[0] for r in clean)
    first = {}
    for r in clean:
        text = re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")
        first[text] = min(first.get(text, r[0]), r[0])
    assert sorted(ids("exact_dedup")) == sorted(first.values())
    left = [r for r in clean if r[0] in set(first.values())]
    classes = defaultdict(list)
    for r, root in zip(left, plain_classes([(r[0], r[1]) for r in left])):
        classes[root].append(r[0])
    assert sorted(ids("near_dedup")) == sorted(min(c) for c in classes.values())
    size = {r[0]: len(words(r[1])) for r in rows}
    times = Counter(ids("source_mix"))
    assert set(times) <= set(ids("near_dedup")) and max(times.values()) <= 2
    total = sum(size[i] for i in ids("near_dedup"))
    assert sum(size[i] * n for i, n in times.items()) == pytest.approx(1.5 * total, abs=10)
    packed = Counter()
    for r in kept["packing"]:
        packed[r["doc_id"]] += r["n_words"]
    assert packed == Counter({i: size[i] * n for i, n in times.items()})
    assert corpus_pipeline.ORACLE_SQL is None
