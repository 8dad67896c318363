"""Best-fit packing of tokenised documents by minimum bin slack.

Each document becomes token ids plus an end id; documents longer than a sequence are cut into
sequence-long pieces behind a first, shorter one.  Minimum bin slack fills one bin after another:
a bitset subset-sum over the lengths still at hand finds the fullest feasible combination (ties
favour longer pieces), which is then removed.

Only how many pieces have each length matters for that, and there are at most ``capacity``
lengths.  So Spark counts lengths, the driver runs the heuristic on that bounded histogram
(applying a combination as often as the counts allow, which is what repeating it would do) and the
resulting table of runs, bounded by the same number, is broadcast.  Each piece finds its place by
its rank among the pieces of its length; ranks are made in salted groups, so a length that holds a
third of all pieces is still ranked by many tasks.

Defined results: null text is empty and packs as its end id alone; a special token's string in a
text is that token, as the tokenizer has it; texts of any length are coded whole; repeated rows are packed once
each, whatever their order (they are alike in all columns); a null id stays null; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._scratch import materialize, tidy

#: Characters of the texts that are coded at once, and new chunks coded as one text.
CALL_CHARS, TOGETHER = 500_000, 200
#: Bytes of the codes that stay, and of each of the two generations of new ones.
KEPT_BYTES, ENTRY_BYTES = 50_000_000, 200
ASCII_SPACE = " \t\n\x0b\x0c\r"
CHUNK = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
MIN_RANK_GROUP = 500


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """[(combination, times)]: combination is ((length, copies), ...), longest first."""
    left = {length: n for length, n in counts.items() if n > 0}
    full = (1 << (capacity + 1)) - 1
    made = []
    while left:
        lengths = sorted(left, reverse=True)
        # reach[i] has bit s set if pieces of lengths[i:] can fill exactly s
        reach = [1] * (len(lengths) + 1)
        for i in range(len(lengths) - 1, -1, -1):
            length = lengths[i]
            bits, copies, step = reach[i + 1], min(left[length], capacity // length), 1
            while copies > 0:
                take = min(step, copies)
                bits |= bits << (length * take)
                copies -= take
                step *= 2
            reach[i] = bits & full
        rest, combination = reach[0].bit_length() - 1, []
        for i, length in enumerate(lengths):
            copies = min(left[length], rest // length)
            while not reach[i + 1] >> (rest - copies * length) & 1:
                copies -= 1
            if copies:
                combination.append((length, copies))
                rest -= copies * length
            if not rest:
                break
        times = min(left[length] // copies for length, copies in combination)
        made.append((tuple(combination), times))
        for length, copies in combination:
            left[length] -= copies * times
            if not left[length]:
                del left[length]
    return made


class Coder:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes.

    A byte-level pre-tokenizer always starts anew before white space that follows other characters,
    so a text may be coded in such chunks; texts with other white space than ASCII's are coded in
    one go.  Codes of chunks are kept: those met again stay while the table has room, those met once
    wait for one or two more generations.  New chunks that start with white space are coded as
    one text; the bytes that each token stands for show where one chunk ends.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # in a byte-level vocabulary each character of a token stands for one byte
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            self.bytes_of[number] = len(token)
        self.kept: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.kept_room, self.room = KEPT_BYTES, KEPT_BYTES

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _code(self, chunks: list[str], whole: set[str]) -> dict[str, bytes]:
        """The ids of new chunks; those in ``whole`` are texts."""
        coded, joined = {}, []
        for c in chunks:
            if c[0] in ASCII_SPACE and c[-1] not in ASCII_SPACE and c not in whole:
                joined.append(c)
            else:
                coded[c] = b""
        for c, ids in zip(list(coded), self._ids(list(coded))):
            coded[c] = ids.tobytes()
        groups = [joined[k : k + TOGETHER] for k in range(0, len(joined), TOGETHER)]
        for group, ids in zip(groups, self._ids(["".join(g) for g in groups])):
            ends = np.cumsum([len(c) if c.isascii() else len(c.encode()) for c in group])
            cuts = (4 * np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 4).tolist()
            data = ids.tobytes()
            coded.update(zip(group, map(data.__getitem__, map(slice, [0, *cuts[:-1]], cuts))))
        return coded

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        if self.room < 0:  # what was met once waits one generation longer
            self.known, self.before, self.room = {}, self.known, KEPT_BYTES
        whole = set(filter(OTHER_SPACE.search, texts))
        chunks = [[t] if t in whole else CHUNK.findall(t) for t in texts]
        distinct = list(set().union(*chunks))
        here = dict(zip(distinct, map(self.kept.get, distinct)))
        again = {}
        for table in (self.known, self.before):
            missing = [c for c, ids in here.items() if ids is None]
            again.update((c, ids) for c, ids in zip(missing, map(table.get, missing)) if ids is not None)
            here.update(again)
        size = ENTRY_BYTES * len(again) + sum(map(len, again))
        if self.kept_room > 0:
            self.kept.update(again)
            self.kept_room -= size
        else:
            self.known.update(again)
            self.room -= size
        new = self._code([c for c, ids in here.items() if ids is None], whole)
        here.update(new)
        self.known.update(new)
        self.room -= ENTRY_BYTES * len(new) + sum(map(len, new))
        return [b"".join(map(here.__getitem__, c)) for c in chunks]


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    """One per Python worker."""
    return Coder(path)


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, end = coder(tokenizer_path), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            rows, at = [], 0
            while at < len(names):
                upto, chars, group = at, 0, []
                while upto < len(names) and (not group or chars < CALL_CHARS):
                    group.append(texts[upto].as_py() or "")
                    chars += len(group[-1])
                    upto += 1
                for name, ids in zip(names[at:upto], made.ids(group)):
                    ids += end
                    length = len(ids) // 4
                    starts = [0, *range(length % capacity or capacity, length, capacity)]
                    for k, (a, b) in enumerate(zip(starts, [*starts[1:], length])):
                        rows.append((name, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
                at = upto
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        tidy(cut), "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def _runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first_rank, last_rank, copies, first_sequence, offset): which ranks of a length go where."""
    used, sequence, runs = dict.fromkeys(counts, 0), 0, []
    for combination, times in minimum_bin_slack(counts, capacity):
        offset = 0
        for length, copies in combination:
            runs.append((length, used[length], used[length] + copies * times - 1, copies, sequence, offset))
            used[length] += copies * times
            offset += copies * length
        sequence += times
    return runs


def place_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to pieces that have doc_id, piece, ids_crc32 and length."""
    spark = pieces.sparkSession
    # at most `capacity` rows come to the driver
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    salts = spark.createDataFrame(
        [(k, max(1, n // max(MIN_RANK_GROUP, isqrt(n)))) for k, n in counts.items()], "length long, salts long"
    )
    runs = spark.createDataFrame(_runs(counts, capacity), "length long, first_rank long, last_rank long, copies long, first_sequence long, run_offset long")
    dealt = pieces.join(F.broadcast(salts), "length").withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts"))
    )
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    group_starts = (
        dealt.groupBy("length", "salt")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("group_start"))
    )
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = (
        dealt.withColumn("inside", F.row_number().over(inside) - 1)
        .join(group_starts, ["length", "salt"])
        .withColumn("rank", F.col("group_start") + F.col("inside"))
    )
    nth = F.col("rank") - F.col("first_rank")
    placed = ranked.join(
        F.broadcast(runs.withColumnRenamed("length", "run_length")),
        (F.col("length") == F.col("run_length")) & F.col("rank").between(F.col("first_rank"), F.col("last_rank")),
    )
    return placed.select(
        *pieces.columns,
        (F.col("first_sequence") + F.floor(nth / F.col("copies"))).alias("sequence_id"),
        (F.col("run_offset") + F.pmod(nth, F.col("copies")) * F.col("length")).alias("offset"),
    )


def pack_documents(
    docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset; tokenised once."""
    pieces = materialize(token_pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col), "pieces")
    return place_pieces(pieces, capacity)
