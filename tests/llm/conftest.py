from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture
def docs(spark):
    """Make a documents table, with extra columns whose names the operators use themselves."""

    def make(rows, columns="doc_id long, text string, lang string, source string, n_chars long"):
        wide = [(*r, *[None] * (5 - len(r))) for r in rows]
        extra = ", _row long, row string, size string, kept string, _p0 string, sketch string, block string"
        return spark.createDataFrame([(*r, 7, "x", "y", "z", "w", "v", "u") for r in wide], columns + extra)

    return make


#: Rows that every operator has to take: NULLs, empty, blank, repeated, very long, short.
ODD_ROWS = [
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "one two three"),
    (4, "one two three"),
    (None, "one two  three"),
    (None, None),
    (5, "word " * 60_000),
    (6, "ünï¢ödé   token=abcdef123 été"),
    (7, " ".join(f"w{i}" for i in range(40))),
    (8, " ".join(f"w{i}" for i in range(40))),
    (9, " ".join(f"w{i}" for i in range(41))),
]
