"""Exact deduplication with two passes over a Bloom filter, in DataFrame functions only.

Pass one sets ``PROBES`` filter positions for each text's hash and keeps the positions that at
least two rows set.  Pass two probes those: a row with a probe that nobody else set cannot have a
copy, so it passes straight through without a shuffle.  Only the possibly repeated rows are grouped
by their full SHA-256, which settles false positives exactly.

The filter is broadcast, so its size is bounded: 32 bits a row up to ``MAX_FILTER_BITS`` (32 MiB of
bits).  Beyond that the share of false positives rises, more rows shuffle, and results stay exact.

Defined results: null text counts as empty; texts equal after white-space folding are copies, so
all empty texts are copies of each other; of rows that tie on ``doc_id`` exactly one stays; null ids
lose to any id; a text of any length is hashed whole; an empty table gives an empty result; other
columns are kept, whatever their names, as helper columns stand beside a struct of the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._scratch import materialize

PROBES = 2
BITS_PER_ROW = 32
MIN_FILTER_BITS = 1 << 16
MAX_FILTER_BITS = 1 << 28


def normalised(text: Column) -> Column:
    """Runs of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def text_hash(text: Column) -> Column:
    """SHA-256 of the normalised text's UTF-8 bytes, as 32 bytes."""
    return F.unhex(F.sha2(normalised(text), 256))


def filter_bits(rows: int) -> int:
    """The power of two of at least BITS_PER_ROW bits a row, within the bounds."""
    wanted = max(MIN_FILTER_BITS, rows * BITS_PER_ROW)
    return min(MAX_FILTER_BITS, 1 << (wanted - 1).bit_length())


def _probe(sha: Column, k: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(sha, F.lit(k)), F.lit(bits))


def repeated_filter(hashes: DataFrame, sha: str, bits: int) -> DataFrame:
    """(word, set_bits) of the filter positions that two or more rows set.

    At most ``bits / 64`` rows, whatever the input: this is the table that may be broadcast.
    """
    probes = F.array_distinct(F.array(*[_probe(F.col(sha), k, bits) for k in range(PROBES)]))
    return (
        hashes.select(F.explode(probes).alias("bit"))
        .groupBy("bit")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .groupBy(F.shiftright("bit", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("set_bits"))
    )


def with_maybe_repeated(rows: DataFrame, sha: str, filter_words: DataFrame, bits: int, flag: str) -> DataFrame:
    """Add the boolean ``flag``: false only for rows whose hash occurs once."""
    out = rows
    for k in range(PROBES):
        words = filter_words.select(
            F.col("word").alias(f"__word{k}"), F.col("set_bits").alias(f"__bits{k}")
        )
        out = out.withColumn(f"__bit{k}", _probe(F.col(sha), k, bits))
        out = out.join(
            F.broadcast(words), F.shiftright(f"__bit{k}", 6) == F.col(f"__word{k}"), "left"
        )
    hit = F.lit(True)
    for k in range(PROBES):
        hit &= F.coalesce(
            F.expr(f"(shiftright(__bits{k}, cast(__bit{k} & 63 as int)) & 1L) = 1L"), F.lit(False)
        )
    return out.withColumn(flag, hit).drop(
        *[f"__{part}{k}" for part in ("word", "bits", "bit") for k in range(PROBES)]
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    hashed = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.monotonically_increasing_id().alias("row"),
            text_hash(F.col(text_col)).alias("sha"),
        ),
        "exact-hashes",
    )
    bits = filter_bits(hashed.count())
    flagged = with_maybe_repeated(hashed, "sha", repeated_filter(hashed, "sha", bits), bits, "maybe")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    groups = (
        flagged.where("maybe")
        .groupBy("sha")
        .agg(F.min(order).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    )
    repeated = flagged.where("maybe").join(groups, "sha").select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"),
        "sha",
    )
    single = flagged.where("not maybe").select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "sha",
    )
    return single.unionByName(repeated).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were.

    Possibly repeated rows are combined on the map side, so of a group of copies each task sends
    one row at most.
    """
    marked = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("sha"))
    hashes = marked.select("sha")
    bits = filter_bits(docs.select(id_col).count())
    flagged = with_maybe_repeated(marked, "sha", repeated_filter(hashes, "sha", bits), bits, "maybe")
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", F.xxhash64("row").alias("tie"))
    repeated = flagged.where("maybe").groupBy("sha").agg(F.min_by("row", first).alias("row"))
    return flagged.where("not maybe").select("row.*").unionByName(repeated.select("row.*"))
