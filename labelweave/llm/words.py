"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column.

A word is a run of bytes other than space and 0x09 to 0x0D. Word hashes are 64-bit polynomials of the
word's bytes, mixed afterwards, so no Python code runs for each word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are taken at a time; one longer text is taken alone.
CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """Invertible scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = values + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def powers(base: np.uint64, count: int) -> np.ndarray:
    out = np.full(count, base, dtype=np.uint64)
    if count:
        out[0] = 1
        with np.errstate(over="ignore"):
            np.cumprod(out, out=out)
    return out


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = _BASE) -> np.ndarray:
    """Polynomial of ``values[start:end]`` in ``base``, independent of the place, mixed."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(base, len(values)), out=sums[1:])
        back = powers(np.uint64(_inverse(int(base))), len(values) + 1)
        raw = (sums[ends] - sums[starts]) * back[starts]
        return mix(raw + mix((ends - starts).astype(np.uint64)))


@dataclass
class Texts:
    """Texts laid end to end: ``data`` and the ``offsets`` between them (one more than texts)."""

    data: np.ndarray
    offsets: np.ndarray
    first: int  # row of the first text within its batch

    def __len__(self) -> int:
        return len(self.offsets) - 1


@dataclass
class Words:
    """Byte bounds of each word, its text, and the first word of each text (one more than texts)."""

    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """Runs of rows with at most ``limit`` bytes of text; NULL is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    rows = len(column)
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + rows + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < rows:
        end = int(np.searchsorted(at, at[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield Texts(data[at[row] : at[end]], at[row : end + 1] - at[row], row)
        row = end


def find_words(texts: Texts, inside: np.ndarray | None = None) -> Words:
    """Runs of the bytes marked by ``inside``, by default all that is no white space."""
    if inside is None:
        inside = ~IS_SPACE[texts.data]
    starts_here = inside.copy()
    starts_here[1:] &= ~inside[:-1]
    ends_here = inside.copy()
    ends_here[:-1] &= ~inside[1:]
    edges = texts.offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(inside))]
    starts_here[edges] = inside[edges]
    ends_here[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(starts_here), np.flatnonzero(ends_here) + 1
    first = np.searchsorted(starts, texts.offsets)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(starts, ends, doc, first)


def word_hashes(texts: Texts, words: Words) -> np.ndarray:
    return span_hashes(texts.data, words.starts, words.ends)


def window_hashes(hashes: np.ndarray, size: int, base: int = 0xD1342543DE82EF95) -> np.ndarray:
    """Hash of each run of ``size`` values; windows across texts are for the caller to leave out."""
    count = max(0, len(hashes) - size + 1)
    at = np.arange(count)
    return span_hashes(hashes, at, at + size, np.uint64(base))


def window_starts(words: Words, size: int) -> np.ndarray:
    """Words at which a window of ``size`` words of one text starts."""
    last = np.maximum(words.first[1:] - size + 1, words.first[:-1])
    return np.flatnonzero(np.arange(len(words.doc)) < np.repeat(last, words.counts()))


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between offsets."""
    sums = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def covered(starts: np.ndarray, size: int, total: int) -> np.ndarray:
    """Which of ``total`` places lie in a window of ``size`` that starts at one of ``starts``."""
    opened = np.bincount(starts, minlength=total + 1)
    closed = np.bincount(np.minimum(starts + size, total), minlength=total + 1)
    return np.cumsum(opened - closed)[:total] > 0
