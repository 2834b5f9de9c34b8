from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from labelweave.llm.rules import text_counts
from labelweave.llm.words import covered, find_words, text_chunks, window_hashes, window_starts, word_hashes

TEXTS = st.lists(st.text(alphabet="ab \n\té #%", max_size=60), max_size=8)


def chunks(texts, limit=1 << 20):
    return list(text_chunks(pa.array(texts, pa.string()), limit))


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(1, 80))
def test_words_and_hashes(texts, limit):
    by_hash = {}
    row = 0
    for part in chunks(texts, limit):
        assert part.first == row
        words = find_words(part)
        hashes = word_hashes(part, words)
        for d in range(len(part)):
            got = [bytes(part.data[s:e]) for s, e in zip(words.starts, words.ends)][words.first[d] : words.first[d + 1]]
            assert got == texts[row].encode().split()
            for w, h in zip(got, hashes[words.first[d] : words.first[d + 1]]):
                assert by_hash.setdefault(w, h) == h
            row += 1
    assert row == len(texts) and len(set(by_hash.values())) == len(by_hash)


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_windows(texts):
    for part in chunks(texts):
        words = find_words(part)
        hashes = word_hashes(part, words)
        starts = window_starts(words, 3)
        assert all(words.doc[s] == words.doc[s + 2] for s in starts)
        runs = window_hashes(hashes, 3)
        keys = {}
        for s in starts:
            assert keys.setdefault(tuple(hashes[s : s + 3]), runs[s]) == runs[s]
        assert len(set(keys.values())) == len(keys)


def test_covered():
    assert covered(np.array([1, 4]), 2, 6).tolist() == [False, True, True, False, True, True]
    assert covered(np.array([], int), 2, 3).tolist() == [False] * 3


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    repeated = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            repeated.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": dup,
        "n_repeat_words": len(repeated),
    }


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_counts_equal_plain_counting(texts):
    row = 0
    for part in chunks(texts, 50):
        counts = text_counts(part)
        for d in range(len(part)):
            for name, value in plain_counts(texts[row]).items():
                assert counts[name][d] == value, (name, texts[row])
            row += 1


@pytest.mark.parametrize("text", ["a b c d e " * 4, "x\ny\nx\n\n y\ny", "#a\n#a\n", "", " ", "\n\n", "a"])
def test_counts_golden(text):
    (part,) = chunks(["before", text, "after"])
    counts = text_counts(part)
    assert {n: counts[n][1] for n in plain_counts(text)} == plain_counts(text)
