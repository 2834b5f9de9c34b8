"""Token counts of whole texts by a two-tier lookup in the map tasks.

A byte-level BPE splits a text by a fixed pattern and encodes each piece (pre-token) on its own, so a text's
count is the sum of its pieces' lengths. The lengths of frequent pieces are learned from a bounded sample of
rows and broadcast as one table; every other piece is encoded once by the library and kept in a cache of the
worker. Pieces never leave their task: counting shuffles nothing.

The sample decides what is fast, not what is right: a piece outside the table is encoded. Where the pattern's
library and the tokenizer's disagree about a character (their Unicode versions differ), the whole text is
encoded by the tokenizer. Special strings in a text are single tokens, as the tokenizer's default has it.

Defined cases: a NULL text is empty and has 0 tokens; equal rows get equal counts, one row for each; an empty
table gives an empty result; extra columns are dropped; texts of any length are counted in pieces.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm.rows import release

# Fixed value: the pattern by which byte-level tokenizers split a text.
PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Rows whose pieces fill the table, on average, and the tasks that count them.
SAMPLE_ROWS = 4_000
SAMPLE_TASKS = 8
#: Entries of the broadcast table; each is a piece of at most ``MAX_KEY`` characters.
TABLE_ENTRIES = 50_000
MAX_KEY = 32
#: Entries of a worker's lookup; when it is full, it starts again from the table.
CACHE_ENTRIES = 250_000
#: Characters from which a text's pieces are taken one by one instead of as a list.
LONG_TEXT = 1 << 20
#: Rows that become Python strings at a time.
SLICE_ROWS = 500


class Lengths(dict):
    """Tokens of a piece: the table first, then what this worker has met, else the library."""

    def __init__(self, table: dict[str, int], encoded: Callable[[str], int], limit: int = CACHE_ENTRIES):
        super().__init__(table)
        self.table, self.encoded, self.limit = table, encoded, max(limit, len(table) + 1)

    def __missing__(self, piece: str) -> int:
        found = self.encoded(piece)
        if len(piece) <= MAX_KEY:
            if len(self) >= self.limit:
                self.clear()
                self.update(self.table)
            self[piece] = found
        return found


class TokenCounter:
    """Counts the tokens of texts; one lives in each worker."""

    def __init__(self, definition: bytes, table: dict[str, int]):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        specials = special_strings(definition)
        # Longer strings first, so that one that starts with another is found whole.
        parts = "|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True))
        self.special = regex.compile(parts) if parts else None
        self.lengths = Lengths(table, self.encoded)
        self.agreed: set[str] = set()
        self.disputed: set[str] = set()

    def encoded(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False))

    def agree(self, text: str) -> bool:
        """Whether both libraries put all characters of the text into the same classes."""
        found = set(text)
        if found & self.disputed:
            return False
        for c in found - self.agreed:
            # One place next to a letter, a digit, a sign and a space tells the class of a character.
            probe = f"a{c}1{c}.{c} "
            given = [span for _, span in self.tokenizer.pre_tokenizer.pre_tokenize_str(probe)]
            (self.agreed if given == [m.span() for m in PIECES.finditer(probe)] else self.disputed).add(c)
        return not found & self.disputed

    def parts(self, text: str) -> list[str]:
        """What lies before, between and after special strings."""
        return self.special.split(text) if self.special else [text]

    def count(self, text: str) -> int:
        if not text.isascii() and not self.agree(text):
            return self.encoded(text)
        parts = self.parts(text)
        total = len(parts) - 1
        for part in parts:
            if len(part) < LONG_TEXT:
                total += sum(map(self.lengths.__getitem__, PIECES.findall(part)))
            else:
                total += sum(self.lengths[m.group()] for m in PIECES.finditer(part))
        return total


def special_strings(definition: bytes) -> list[str]:
    """Added strings of a byte-level BPE; raises for a tokenizer that works in another way."""
    given = json.loads(definition)
    split = given["pre_tokenizer"] or {}
    plain = given["model"]["type"] == "BPE" and given["normalizer"] is None and split.get("type") == "ByteLevel"
    if not plain or split.get("add_prefix_space") or not split.get("use_regex", True):
        raise ValueError("only a byte-level BPE without a normalizer is counted by its pieces")
    added = given["added_tokens"]
    if any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in added):
        raise ValueError("added strings that look at their neighbours are not supported")
    return [a["content"] for a in added]


_COUNTERS: dict[tuple[bytes, bytes], TokenCounter] = {}


def worker_counter(definition: bytes, table: bytes) -> TokenCounter:
    """The worker's counter, kept from task to task with all it has met."""
    found = _COUNTERS.get((definition, table))
    if found is None:
        entries = pa.ipc.open_stream(table).read_all()
        known = dict(zip(entries["piece"].to_pylist(), entries["length"].to_pylist()))
        _COUNTERS.clear()
        found = _COUNTERS[(definition, table)] = TokenCounter(definition, known)
    return found


def _texts(batch: pa.RecordBatch) -> Iterator[list[str]]:
    column = batch.column(batch.num_columns - 1)
    for at in range(0, len(column), SLICE_ROWS):
        yield [t or "" for t in column.slice(at, SLICE_ROWS).to_pylist()]


def _piece_batches(definition: bytes):
    """The most frequent short pieces of a task's rows, how often they occur, and their lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, seen = TokenCounter(definition, {}), Counter()
        for batch in batches:
            for texts in _texts(batch):
                for text in texts:
                    for part in counter.parts(text):
                        seen.update(m.group() for m in PIECES.finditer(part) if m.end() - m.start() <= MAX_KEY)
        # Ties by piece, so that equal samples give equal tables.
        often = sorted(seen.items(), key=lambda e: (-e[1], e[0]))[:TABLE_ENTRIES]
        pieces = [p for p, _ in often if counter.agree(p)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(pieces, pa.string()),
                pa.array([counter.encoded(p) for p in pieces], pa.int32()),
                pa.array([seen[p] for p in pieces], pa.int64()),
            ],
            ["piece", "length", "seen"],
        )
        release()

    return run


def frequent_lengths(docs: DataFrame, definition: bytes, *, text: str = "text", seed: int = 0) -> bytes:
    """Table of at most ``TABLE_ENTRIES`` pieces, as an Arrow stream; the driver gets ``SAMPLE_TASKS`` such lists."""
    total = docs.count()
    share = min(1.0, SAMPLE_ROWS / total) if total else 1.0
    sample = docs.select(text).sample(share, seed=seed).repartition(SAMPLE_TASKS)
    lists = sample.mapInArrow(_piece_batches(definition), "piece string, length int, seen long").toArrow()
    merged = lists.group_by(["piece", "length"]).aggregate([("seen", "sum")])
    merged = merged.sort_by([("seen_sum", "descending"), ("piece", "ascending")]).slice(0, TABLE_ENTRIES)
    entries = merged.select(["piece", "length"]).combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, entries.schema) as writer:
        writer.write_table(entries)
    return sink.getvalue().to_pybytes()


def _count_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_counter(*shared.value)
        for batch in batches:
            counts = [counter.count(t) for texts in _texts(batch) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(counts, pa.int64())], [*batch.schema.names[:-1], "n_tokens"]
            )
        release()

    return run


def read_definition(spark: SparkSession, path: str) -> bytes:
    """The tokenizer's file (a few MB): from the driver's disk, or else from a store that Spark reads."""
    if os.path.exists(path):
        with open(path, "rb") as file:
            return file.read()
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])


def token_counts(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens) of each row of ``docs``; ``tokenizer`` is the path of a byte-level BPE's JSON file."""
    spark = docs.sparkSession
    definition = read_definition(spark, tokenizer)
    special_strings(definition)
    rows = docs.select(
        docs[key].alias(key),
        F.octet_length(F.coalesce(docs[text], F.lit(""))).cast("long").alias("n_bytes"),
        docs[text].alias("text"),
    )
    # Bounded: the file and ``TABLE_ENTRIES`` short strings.
    shared = spark.sparkContext.broadcast((definition, frequent_lengths(docs, definition, text=text)))
    schema = rows.select(key, "n_bytes").schema.add("n_tokens", "long")
    return rows.mapInArrow(_count_batches(shared), schema)
