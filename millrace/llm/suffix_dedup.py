"""Repeated byte windows by a depth-limited radix sort of suffixes, and their removal.

A suffix is compared through its first ``depth`` bytes only.  Sorting all suffixes would shuffle a row a
byte, so the first, most significant digit is one that few suffixes carry: the gram of ``GRAM`` bytes with the
least hash among those of a window of ``depth`` bytes (leftmost on ties), which equal windows share at the
same place.  Consecutive windows with the same such gram form a segment, some 15 of them on average.

* Pass one orders segments by their gram, then by all their bytes.  A gram met once ends here.  Segments
  equal in all bytes are one group: its windows repeat in every document but the first.
* Where a gram has unequal segments, their windows go on to pass two, one for each group of equal segments,
  and are ordered by all ``depth`` bytes; equal groups there are exactly the repeated windows.

Digits travel as hashes: 40 bits and the shard's for the order, 32 more that must agree for a group to be
equal; the shard's bits grow with the input, to some 95 in all at 100 TB.  Documents are written as blocks of some ``BLOCK_BYTES`` first, so that a block has a name that survives
lost executors.  Each block sends at most one entry for a digit and group (``MANY`` groups of a
digit, beyond that one mark that sends all its windows to pass two), so a hot gram
or copies in a third of all documents cost one entry a block.  Answers return to the blocks, whose compressed
text moves once, for both passes.

Defined results: null text is empty; matches never cross documents; rows that share an id do not repeat each
other; rows without an id come after all others and do not repeat each other; texts shorter than ``depth``
stay; very long texts are cut into blocks of their own and worked through slice by slice; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._scratch import materialize, tidy

DEPTH = 50
GRAM = 20
BLOCK_BYTES = 2 << 20
#: Windows worked on together; a longer text is cut, windows are not.
SLICE_BYTES = 1 << 20
#: Entries of one shard on average.
SHARD_ENTRIES = 400_000
#: Groups of one gram that a block sends one by one.
MANY = 16
NO_ID = np.iinfo(np.int64).max

_U = np.uint64
_CHECK = _U(0xFFFFFFFF)
_RANDOM = np.random.default_rng(20240229).integers(1, 2**63, (2, 257), dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> _U(shift))) * _U(factor)
    return x ^ (x >> _U(33))


class _Rolling:
    """Hashes of any stretch of one slice of bytes, modulo 2**64, by prefix sums."""

    def __init__(self, data: np.ndarray, which: int):
        base = _RANDOM[which, 256] | _U(1)
        inverse = _U(pow(int(base), -1, 1 << 64))
        self.back = self._powers(inverse, len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_RANDOM[which, :256][data] * self._powers(base, len(data)), dtype=np.uint64, out=self.prefix[1:])

    @staticmethod
    def _powers(base: np.uint64, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[:1] = 1
        return np.multiply.accumulate(out)

    def grams(self, length: int) -> np.ndarray:
        """The hash of every stretch of ``length`` bytes."""
        p = self.prefix
        return _mixed((p[length:] - p[:-length]) * self.back[: len(p) - length] + _U(length))

    def stretches(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mixed((self.prefix[stop] - self.prefix[start]) * self.back[start] + (stop - start).astype(np.uint64))


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` values the place of its least, the leftmost of equal ones."""
    place = np.arange(len(values), dtype=np.int32)
    held, size = values, 1
    while size < width:
        step = min(size, width - size)
        right = held[step:] < held[:-step]
        place = np.where(right, place[step:], place[:-step])
        held, size = values[place], size + step
    return place


def _slices(lengths: np.ndarray, depth: int) -> Iterator[tuple[int, int]]:
    """(first, end) of window starts of a block, SLICE_BYTES at a time."""
    total = int(lengths.sum())
    for first in range(0, max(total - depth + 1, 0), SLICE_BYTES):
        yield first, min(first + SLICE_BYTES, total - depth + 1)


def segments(data: np.ndarray, lengths: np.ndarray, depth: int) -> Iterator[dict[str, np.ndarray]]:
    """Of documents laid end to end: per slice the segments' first window, end, document, gram hash and
    hash of all bytes, and the slice's rolling hashes under ``rolling`` with its offset."""
    doc_end = np.cumsum(lengths)
    for first, end in _slices(lengths, depth):
        piece = data[first : end + depth - 1]
        one, two = _Rolling(piece, 0), _Rolling(piece, 1)
        gram = min(GRAM, depth)
        order = one.grams(gram)
        least = leftmost_least(order, depth - gram + 1)
        start = np.arange(first, end)
        doc = np.repeat(np.arange(len(lengths)), np.diff(np.clip(np.concatenate([[0], doc_end]), first, end)))
        good = start + depth <= doc_end[doc]
        change = np.ones(len(start), bool)
        change[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
        begin = np.flatnonzero(change & good)
        stop_at = np.flatnonzero(good & np.concatenate([change[1:] | ~good[1:], [True]]))
        yield {
            "first": begin + first,
            "end": stop_at + 1 + first,
            "doc": doc[begin],
            "gram": order[least[begin]],
            "check": two.stretches(begin, stop_at + depth) & _CHECK | _U(1),
            "rolling": (one, two, first),
        }


def _squeezed(*columns: np.ndarray) -> bytes:
    """64-bit columns of one length, byte planes apart, compressed."""
    n = len(columns[0])
    planes = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(n, 8).T.tobytes() for c in columns)
    return n.to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _spread(data: bytes, columns: int) -> list[np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=8 * n * columns, codec="zstd", asbytes=True), np.uint8)
    return [np.ascontiguousarray(c.reshape(8, n).T).view(np.uint64).ravel() for c in planes.reshape(columns, 8 * n)]


def _deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x[:1] * 0)


#: Entries of one block and shard: key (40 bits), check, and the least and greatest id of its documents.
_ENTRY_SCHEMA = "block long, shard long, entries binary"
_ANSWER_SCHEMA = "block long, shard long, answers binary"


def _packed(block: int, key: np.ndarray, check: np.ndarray, low: np.ndarray, high: np.ndarray, shards: int) -> pa.Table:
    """Entries of a block (sorted by hash and check) as one row a shard, sorted by shard, key and check."""
    shard = (key & _U(0xFFFFFF)) % _U(shards)
    digit = key >> _U(24)
    order = np.lexsort((check, digit, shard))
    shard, digit, check, low, high = (x[order] for x in (shard, digit, check, low, high))
    cuts = np.flatnonzero(np.diff(shard, prepend=shard[:1] + _U(1)))
    rows = []
    for a, b in zip(cuts, [*cuts[1:], len(shard)]):
        ids = low[a:b].view(np.uint64)
        rows.append(_squeezed(_deltas(digit[a:b]), check[a:b], ids - ids.min(), (high[a:b] - low[a:b]).view(np.uint64), np.full(b - a, ids.min(), np.uint64)))
    names = ["block", "shard", "entries"]
    return pa.Table.from_arrays([pa.array(np.full(len(cuts), block)), pa.array(shard[cuts].astype(np.int64)), pa.array(rows, pa.binary())], names=names)


def _order(key: np.ndarray, shards: int, check: np.ndarray) -> np.ndarray:
    """The order in which ``_packed`` lays entries."""
    return np.lexsort((check, key >> _U(24), (key & _U(0xFFFFFF)) % _U(shards)))


def answered(entries: DataFrame) -> DataFrame:
    """Per block and shard: of each entry the first document of its group and whether its digit is split.

    One group of rows is a shard; entries of a shard are one or few a digit and block.
    """

    def merge(table: pa.Table) -> pa.Table:
        parts = [_spread(x.as_py(), 5) for x in table["entries"]]
        sizes = [len(p[0]) for p in parts]
        digit = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
        check = np.concatenate([p[1] for p in parts])
        low = np.concatenate([(p[2] + p[4]).view(np.int64) for p in parts])
        high = low + np.concatenate([p[3] for p in parts]).view(np.int64)
        order = np.lexsort((check, digit))
        d, c = digit[order], check[order]
        new_digit = np.ones(len(d), bool)
        new_digit[1:] = d[1:] != d[:-1]
        new_group = new_digit.copy()
        new_group[1:] |= c[1:] != c[:-1]
        digits, groups = np.flatnonzero(new_digit), np.flatnonzero(new_group)
        in_digit, in_group = np.cumsum(new_digit) - 1, np.cumsum(new_group) - 1
        group_low = np.minimum.reduceat(low[order], groups)
        group_high = np.maximum.reduceat(high[order], groups)
        digit_low = np.minimum.reduceat(low[order], digits)
        digit_high = np.maximum.reduceat(high[order], digits)
        marked = np.bitwise_or.reduceat(c == 0, digits)
        several = np.add.reduceat(new_group.astype(np.int64), digits) > 1
        split = ((marked | several) & (digit_low < digit_high))[in_digit]
        useful = split | (group_low < group_high)[in_group]
        first, flag = np.empty(len(d), np.int64), np.empty(len(d), np.int64)
        first[order] = group_low[in_group]
        flag[order] = split + 2 * useful
        out, at = [], 0
        for n in sizes:
            keep = np.flatnonzero(flag[at : at + n])
            out.append(_squeezed(_deltas(keep.astype(np.uint64)), first[at : at + n][keep].view(np.uint64), (flag[at : at + n][keep] & 1).astype(np.uint64)) if len(keep) else None)
            at += n
        kept = pa.array([x is not None for x in out])
        return pa.Table.from_arrays([table["block"].filter(kept), table["shard"].filter(kept), pa.array(out, pa.binary()).filter(kept)], names=["block", "shard", "answers"])

    return entries.groupBy("shard").applyInArrow(merge, _ANSWER_SCHEMA)


def _answers(table: pa.Table, key: np.ndarray, check: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """For entries (key, check): the first document of the group, NO_ID where nothing repeats, and whether
    the digit is split."""
    order = _order(key, shards, check)
    shard = ((key & _U(0xFFFFFF)) % _U(shards))[order].astype(np.int64)
    first, split = np.full(len(key), NO_ID), np.zeros(len(key), bool)
    for number, data in zip(table["shard"].to_pylist(), table["answers"].to_pylist()):
        at, low, flag = _spread(data, 3)
        where = order[np.searchsorted(shard, number) + np.cumsum(at, dtype=np.uint64).astype(np.int64)]
        first[where], split[where] = low.view(np.int64), flag.astype(bool)
    return first, split


def _merged(key: np.ndarray, check: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (key, check), their least ``low`` and greatest ``high``, and the group of each row."""
    order = np.lexsort((check, key))
    k, c = key[order], check[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    begin = np.flatnonzero(new)
    group = np.empty(len(k), np.int64)
    group[order] = np.cumsum(new) - 1
    if not len(k):
        return key, check, low, high, group
    return k[begin], c[begin], np.minimum.reduceat(low[order], begin), np.maximum.reduceat(high[order], begin), group


class _Block:
    """One block of documents read back."""

    def __init__(self, table: pa.Table, depth: int):
        row = {c: table[c][0].as_py() for c in ("block", "ids", "lengths", "size", "text")}
        self.number, self.depth = row["block"], depth
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.lengths = np.frombuffer(row["lengths"], np.int64)
        self.data = np.frombuffer(pa.decompress(row["text"], decompressed_size=row["size"], codec="zstd", asbytes=True), np.uint8) if row["size"] else np.zeros(0, np.uint8)
        self.offsets = np.cumsum(self.lengths) - self.lengths

    def documents(self, at: np.ndarray) -> np.ndarray:
        """The document of each byte."""
        return np.searchsorted(np.cumsum(self.lengths), at, "right")

    def first_pass(self) -> tuple[dict[str, np.ndarray], tuple[np.ndarray, ...], np.ndarray]:
        """All segments; the entries they come down to; the entry of each segment."""
        found = [{k: v for k, v in s.items() if k != "rolling"} for s in segments(self.data, self.lengths, self.depth)]
        names = ("first", "end", "doc", "gram", "check")
        every = {k: np.concatenate([s[k] for s in found]) if found else np.zeros(0, np.uint64 if k in ("gram", "check") else np.int64) for k in names}
        ids = self.ids[every["doc"]]
        key, check, low, high, group = _merged(every["gram"], every["check"], ids, ids)
        if len(key):  # a gram with many unequal segments is one mark
            new = np.concatenate([[True], key[1:] != key[:-1]])
            gram = np.cumsum(new) - 1
            many = (np.bincount(gram) > MANY)[gram]
            key, check, low, high, went = _merged(key, np.where(many, _U(0), check), low, high)
            group = went[group]
        return every, (key, check, low, high), group

    def windows(self, chosen: np.ndarray, every: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, hash, second hash) of all windows of the chosen segments."""
        starts = [np.zeros(0, np.int64)]
        one, two = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        first, end = every["first"][chosen], every["end"][chosen]
        n = end - first
        wanted = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        for a, b in _slices(self.lengths, self.depth):
            here = wanted[(wanted >= a) & (wanted < b)]
            if len(here):
                piece = self.data[a : b + self.depth - 1]
                starts.append(here)
                one.append(_Rolling(piece, 0).stretches(here - a, here - a + self.depth))
                two.append(_Rolling(piece, 1).stretches(here - a, here - a + self.depth) & _CHECK | _U(1))
        return np.concatenate(starts), np.concatenate(one), np.concatenate(two)


def _blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(block, ids, lengths, size, text): documents in blocks, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=6)
        base, count, held, ids, texts = TaskContext.get().partitionId() << 32, 0, 0, [], []

        def block() -> pa.RecordBatch:
            data = b"".join(texts)
            lengths = np.array([len(t) for t in texts], np.int64)
            row = {"block": base + count, "ids": np.array(ids, np.int64).tobytes(), "lengths": lengths.tobytes(), "size": len(data), "text": codec.compress(data, asbytes=True) if data else b""}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("lengths", pa.binary()), ("size", pa.int64()), ("text", pa.binary())]))

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(NO_ID if doc_id is None else doc_id)
                texts.append(text or b"")
                held += len(texts[-1])
                if held >= BLOCK_BYTES or len(ids) >= BLOCK_BYTES // 64:
                    yield block()
                    count, held, ids, texts = count + 1, 0, [], []
        if ids:
            yield block()

    rows = docs.select(docs[id_col].cast("long"), docs[text_col].cast("binary"))
    return materialize(rows.mapInArrow(tidy(run), "block long, ids binary, lengths binary, size long, text binary"), "text-blocks")


def _covered(first: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """Per byte whether one of the stretches covers it."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge[:-1]) > 0


def repeated_bytes(docs: DataFrame, make: Callable, schema: str, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """``make(id, text bytes, removed mask)`` per document, a row of ``schema`` each."""
    blocks = _blocks(docs, id_col, text_col)
    total = blocks.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total // (SHARD_ENTRIES * 15)))
    names = [c.split()[0] for c in schema.split(", ")]

    def first_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block = _Block(pa.Table.from_batches([batch.slice(k, 1)]), depth)
                _, entries, _ = block.first_pass()
                if len(entries[0]):
                    yield from _packed(block.number, *entries, shards).to_batches()

    first = materialize(answered(blocks.mapInArrow(tidy(first_entries), _ENTRY_SCHEMA)), "first-answers")

    def judged(block: _Block, table: pa.Table) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
        """Stretches that pass one decides, as first bytes and ends, and the windows that it leaves open."""
        every, (key, check, _, _), group = block.first_pass()
        head, split = _answers(table, key, check, shards)
        gone = (block.ids[every["doc"]] > head[group]) & (check[group] != 0)
        return every["first"][gone], every["end"][gone] + depth - 1, block.windows(np.flatnonzero(split[group] & ~gone), every)

    def second_entries(left: pa.Table, right: pa.Table) -> pa.Table:
        block = _Block(left, depth)
        start, one, two = judged(block, right)[2]
        ids = block.ids[block.documents(start)]
        return _packed(block.number, *_merged(one, two, ids, ids)[:4], shards)

    by_block = blocks.groupBy("block")
    second = answered(by_block.cogroup(first.groupBy("block")).applyInArrow(second_entries, _ENTRY_SCHEMA))
    both = first.withColumn("pass", F.lit(1)).unionByName(second.withColumn("pass", F.lit(2)))

    def last(left: pa.Table, right: pa.Table) -> pa.Table:
        block = _Block(left, depth)
        begin, end, (start, one, two) = judged(block, right.filter(pc.equal(right["pass"], 1)))
        ids = block.ids[block.documents(start)]
        key, check, _, _, group = _merged(one, two, ids, ids)
        head, _ = _answers(right.filter(pc.equal(right["pass"], 2)), key, check, shards)
        gone = start[ids > head[group]] if len(start) else start
        mask = _covered(np.concatenate([begin, gone]), np.concatenate([end, gone + depth]), len(block.data))
        out = []
        for doc_id, at, size in zip(block.ids.tolist(), block.offsets.tolist(), block.lengths.tolist()):
            out.append(make(None if doc_id == NO_ID else doc_id, block.data[at : at + size], mask[at : at + size]))
        return pa.Table.from_pylist([dict(zip(names, row)) for row in out], schema=pa.schema([(n, _TYPES[c.split()[1]]) for n, c in zip(names, schema.split(", "))]))

    return by_block.cogroup(both.groupBy("block")).applyInArrow(last, schema)


_TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""

    def digest(doc_id, data, mask):
        spans = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
        return doc_id, len(data), int(mask.sum()), spans, hashlib.sha256(data[~mask].tobytes()).hexdigest()

    return repeated_bytes(docs, digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", id_col, text_col, depth)


def kept_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """doc_id and the bytes that stay, of every row; a cut may fall inside a character."""
    return repeated_bytes(docs, lambda doc_id, data, mask: (doc_id, data[~mask].tobytes()), "doc_id long, kept binary", id_col, text_col, depth)
