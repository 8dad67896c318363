"""Document fingerprints: threshold-scaled sketches of five-word shingles.

A sketch keeps every shingle hash below ``FRACTION`` of the hash range, so its size follows the
document and two sketches of very unequal documents compare on the same sample of the shingle space:
``likeness`` estimates the Jaccard similarity and ``containment`` the share of one inside the other.
Sketches merge by union.  A document none of whose hashes is below the threshold keeps its smallest
one, so that only texts without words have an empty sketch.

``edited_fingerprints`` also pairs each document with the next one by descending id.  Instead of a
window over all rows, ids are cut into ranges at quantiles; each range is sorted by itself and gets
the first document of the next range as a guest.  Texts are shuffled once.

Defined results: null text is empty; texts without words have the empty fingerprint and are alike
with each other (1) and unlike anything else (0); rows that share an id follow each other by text;
null ids come last; a table of one row is its own next document; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._scratch import tidy

from millrace.llm.near_dup import shingle_set

FRACTION = 0.25
#: Rows per id range, and the most ranges (their first ids come to the driver).
RANGE_ROWS, MAX_RANGES = 5_000, 20_000

_LIMIT = np.uint64(int(FRACTION * 2**64))


def sketch(text: str) -> np.ndarray:
    """Sorted distinct 32-bit tops of the retained shingle hashes."""
    hashes = shingle_set(text)
    kept = hashes[: np.searchsorted(hashes, _LIMIT)]
    return np.unique(((kept if len(kept) else hashes[:1]) >> np.uint64(32)).astype(np.uint32))


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of both documents' shingles together."""
    both = np.union1d(a, b)
    below = both[: np.searchsorted(both, np.uint32(int(_LIMIT) >> 32))]
    return below if len(below) else both[:1]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has too."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def as_text(a: np.ndarray) -> str:
    """Eight hex digits for each retained hash, in order."""
    return a.astype(">u4").tobytes().hex()


def from_text(text: str) -> np.ndarray:
    """The inverse of ``as_text``."""
    return np.frombuffer(bytes.fromhex(text), ">u4").astype(np.uint32)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint: the operator by itself, without any shuffle."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [as_text(sketch(text.as_py() or "")) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        tidy(make), "doc_id long, fingerprint string"
    )


def in_ranges_with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) dealt to id ranges and sorted by descending id; the row after the last of
    a range is the first of the next range, marked ``guest``.  Columns: range, guest, doc_id, text."""
    rows = docs.count()
    ranges = int(min(MAX_RANGES, max(1, -(-rows // RANGE_ROWS))))
    steps = [k / ranges for k in range(1, ranges)]
    cuts = docs.select(F.percentile_approx("doc_id", steps, 10 * ranges)).first()[0] if steps else []
    ordered = np.array(sorted(set(cuts or [])), dtype=np.int64)

    @F.pandas_udf("long")
    def range_of(ids: pd.Series) -> pd.Series:
        # descending: the highest ids are range 0, null ids the last range
        at = len(ordered) - np.searchsorted(ordered, ids.fillna(0).to_numpy().astype(np.int64), side="left")
        return pd.Series(np.where(ids.isna(), len(ordered) + 1, at))

    first = docs.select("doc_id", range_of("doc_id").alias("range")).groupBy("range").agg(F.max("doc_id").alias("first_id"))
    tops = sorted(first.collect(), key=lambda r: r["range"])  # at most MAX_RANGES + 1 rows
    before = docs.sparkSession.createDataFrame(
        [(t["range"], t["first_id"], tops[k - 1]["range"]) for k, t in enumerate(tops)], "own long, first_id long, before long"
    )
    dealt = (
        docs.withColumn("own", range_of("doc_id"))
        .join(F.broadcast(before), "own")
        .withColumn(
            "place",
            F.explode(
                F.when(
                    F.col("doc_id").eqNullSafe(F.col("first_id")),
                    F.array(F.struct(F.col("own").alias("range"), F.lit(False).alias("guest")), F.struct(F.col("before").alias("range"), F.lit(True).alias("guest"))),
                ).otherwise(F.array(F.struct(F.col("own").alias("range"), F.lit(False).alias("guest"))))
            ),
        )
        .select("place.range", "place.guest", "doc_id", "text")
    )
    return dealt.repartition(max(1, len(tops)), "range").sortWithinPartitions("range", "guest", F.desc_nulls_last("doc_id"), "text")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            rows = []
            for where, guest, name, text in zip(*(batch.column(k) for k in range(4))):
                where, guest, name, text = where.as_py(), guest.as_py(), name.as_py(), text.as_py()
                if guest and (waiting is None or waiting[0] != where):
                    continue
                own = sketch(text)
                if waiting is not None and waiting[0] == where:
                    _, last, before, mark = waiting
                    half = len(before) // 2
                    edited = before[: len(before) - half] + text[:half]
                    other = sketch(edited)
                    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((last, len(before), digest, as_text(mark), as_text(other), likeness(mark, other), likeness(mark, own)))
                waiting = None if guest else (where, name, text, own)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            columns = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=NAMES)

    NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return in_ranges_with_next(texts).mapInArrow(
        tidy(compare), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
