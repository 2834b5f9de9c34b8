"""Secret scans with an incremental ledger of blobs.

Every version of a text is addressed by the SHA-256 of its bytes. The ledger remembers, for each rule version,
which blobs have been scanned and what was found; a scan reads only the blobs that the ledger lacks for the
current rule version and appends them. Findings are joined back to every path (row) that has the blob. Blobs are
told apart by their digests first, so texts that the ledger knows are not shuffled.

Defined cases: a NULL text is empty; repeated rows and paths get the findings of their blob, each row its own;
an empty text has no findings but is in the ledger; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.scratch import settle

# Kinds in order, with pattern, group that must be long enough, and its least length.
_KEYS = "|".join(
    "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    for word in ("password", "passwd", "secret", "token", "api_?key")
)
RULES = (
    ("assign", rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
# A text without any of these strings has no finding of the kind.
MARKS = {"assign": (":", "="), "access": ("AKIA",)}
# A run of fewer than 24 never counts and ends where the next run cannot start, so it need not be matched.
PATTERNS = {kind: f"[0-9a-f]{{{least},}}" if kind == "hex" else pattern for kind, pattern, _, least in RULES}
#: Changes whenever a rule changes, or the way in which it is matched.
RULE_VERSION = hashlib.sha256(repr((RULES, MARKS, PATTERNS)).encode()).hexdigest()[:16]

LEDGER = "rule_version string, blob string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
_FOUND = LEDGER.removeprefix("rule_version string, ")

_COMPILED = [(re.compile(PATTERNS[kind]), MARKS.get(kind), group, least) for kind, _, group, least in RULES]
#: Unseen blobs up to this number are broadcast by their digests (64 letters each).
BROADCAST_BLOBS = 200_000


def find_secrets(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of each finding, in code points, by start and then kind."""
    found = []
    for kind, (pattern, marks, group, least) in enumerate(_COMPILED):
        if marks is None or any(mark in text for mark in marks):
            found += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for blob, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = find_secrets(text.as_py() or "")
            kinds = [k for _, k, _ in found]
            spans = ",".join(f"{RULES[k][0]}:{a}:{b}" for a, k, b in found)
            digest = hashlib.sha256(spans.encode()).hexdigest()
            rows.append((blob, kinds.count(0), kinds.count(1), kinds.count(2), digest, spans))
        columns = list(zip(*rows)) or [()] * 6
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)],
            ["blob", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


@dataclass(frozen=True)
class BlobLedger:
    """Findings of the blobs scanned so far, in one folder with a part for each rule version."""

    path: str

    def read(self, spark: SparkSession, version: str = RULE_VERSION) -> DataFrame:
        """Findings for one rule version, a row for each blob; empty if nothing has been scanned."""
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/rule_version={version}")
        there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
        if not there:
            return spark.createDataFrame([], _FOUND)
        # Two scans at once may have appended the same blob.
        return spark.read.schema(_FOUND).parquet(folder.toString()).dropDuplicates(["blob"])

    def scan(self, versions: DataFrame, *, text: str = "text", version: str = RULE_VERSION) -> None:
        """Scan the texts that the ledger lacks and append them.

        Digests are compared first. If few blobs are unseen, their digests are broadcast and only their texts are
        shuffled; else equal texts are united before they are shuffled, so a blob with many paths costs one text
        for each partition. A failed append leaves the ledger without the new blobs, and the scan can be run again.
        """
        spark = versions.sparkSession
        body = F.coalesce(versions[text], F.lit(""))
        blobs = versions.select(F.sha2(body, 256).alias("blob"), body.alias("body"))
        known = self.read(spark, version).select("blob")
        texts = blobs.dropDuplicates(["blob"])
        if known.isEmpty():
            unseen = texts
        else:
            new = settle(blobs.select("blob").distinct().join(known, "blob", "left_anti"), "unseen")
            count = new.count()
            if not count:
                return
            if count <= BROADCAST_BLOBS:
                unseen = blobs.join(F.broadcast(new), "blob", "left_semi").dropDuplicates(["blob"])
            else:
                unseen = texts.join(new, "blob", "left_semi")
        unseen.mapInArrow(_scan, _FOUND).write.mode("append").parquet(f"{self.path}/rule_version={version}")


def scan_documents(
    docs: DataFrame, ledger: BlobLedger, *, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, blob, n_assign, n_access, n_hex, base_sha256, spans) of each row, scanning only unseen blobs."""
    ledger.scan(docs, text=text)
    # Stored without repeats, so that the join is a plain one whose hot blobs adaptive execution can split.
    found = settle(ledger.read(docs.sparkSession), "findings")
    blob = F.sha2(F.coalesce(docs[text], F.lit("")), 256).alias("blob")
    return docs.select(docs[key].alias("doc_id"), blob).join(found, "blob").select("doc_id", *found.columns)
