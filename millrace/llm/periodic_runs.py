"""Periodic runs of words: stretches that repeat one period three times or more.

For each period p the grid points are 0, p, 2p, ...: over all periods their number is harmonic, n log n.
A run of period p holds two grid points, and from its first one the words go on agreeing with those p
places later for ``max(least - 2p, p) + 1`` words.  One comparison of prefix hashes tells for all (period,
grid point) pairs at once which agree that long; for those, a binary search over prefix hashes, again for
all pairs together, gives the longest common extension to the right and to the left.  The words of each
stretch found are compared themselves, so results do not rest on hashes, and stretches found by several
grid points or by multiples of their period are kept once, with the smallest period.

Documents are independent: no shuffle.  Pairs are worked on ``PAIR_BLOCK`` at a time, documents together
until they have ``BATCH_WORDS`` words, so memory is bounded by the longest document.

Defined results: null and empty texts have no words and no run; a text of any length is taken whole; rows
that repeat give repeated rows; ``plant`` leaves rows without an id as they are; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm._scratch import tidy

LEAST_WORDS, LEAST_PERIODS = 24, 3
PAIR_BLOCK = 1 << 18
BATCH_WORDS = 1 << 16

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values spread over the whole range."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    """The base to the powers 0 to n - 1, modulo 2**64."""
    out = np.ones(max(n, 1), np.uint64)
    out[1:] = _BASE
    return np.multiply.accumulate(out)


def planted(words: np.ndarray, doc_id: int | None) -> np.ndarray:
    """The words of a document whose tail is made periodic where the CRC of its id ends in 0."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([words[:a], words[a + np.arange(n - a) % p]])


class _Hashes:
    """Prefix hashes of words laid end to end; pairs never leave their document."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.power = _powers(len(words) + 1)
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(words + 1) * self.power[:-1], dtype=np.uint64)])

    def agree(self, at: np.ndarray, period: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether ``length`` words from ``at`` hash like those ``period`` places later."""
        s = self.prefix
        return (s[at + length] - s[at]) * self.power[period] == s[at + period + length] - s[at + period]

    def extension(self, at: np.ndarray, period: np.ndarray, most: np.ndarray, right: bool) -> np.ndarray:
        """The longest agreement from ``at`` rightwards, or of the words before it leftwards, by
        binary search for all pairs together; one more word than found surely disagrees."""
        low, high = np.zeros_like(most), most.copy()
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            good = self.agree(at if right else at - middle, period, middle)
            low, high = np.where(open_ & good, middle, low), np.where(open_ & ~good, middle - 1, high)
        return low


def _grid(lengths: np.ndarray, starts: np.ndarray, least: int, periods: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of (document, period, grid point) for all documents, at most PAIR_BLOCK pairs each."""
    per_doc = np.where(lengths >= least, lengths // periods, 0)
    doc = np.repeat(np.arange(len(lengths)), per_doc)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc) + 1
    need = np.maximum(least - 2 * period, (periods - 2) * period) + 1
    points = np.maximum(lengths[doc] - period - need, -1) // period + 1
    ends = np.cumsum(points)
    total = int(ends[-1]) if len(ends) else 0
    for begin in range(0, total, PAIR_BLOCK):
        rank = np.arange(begin, min(begin + PAIR_BLOCK, total))
        k = np.searchsorted(ends, rank, "right")
        point = (rank - (ends[k] - points[k])) * period[k]
        yield doc[k], period[k], starts[doc[k]] + point, need[k]


def _exact_extent(words: np.ndarray, at: int, p: int, start: int, stop: int) -> tuple[int, int]:
    """The stretch of period p around ``at`` by comparing words; for hashes that deceived."""
    differ = np.flatnonzero(words[start : stop - p] != words[start + p : stop]) + start
    k = np.searchsorted(differ, at)
    return (int(differ[k - 1]) + 1 if k else start), (int(differ[k]) + p if k < len(differ) else stop)


def find_runs(documents: list[np.ndarray], least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[list[tuple[int, int, int]]]:
    """Per document (word codes) its runs as (start, length, period), by start, then period.

    A run is a stretch of at least ``least`` words and ``periods`` (2 or more) of its smallest period
    that no neighbouring word extends.
    """
    lengths = np.array([len(d) for d in documents], np.int64)
    starts = np.cumsum(lengths) - lengths
    words = np.concatenate([np.zeros(0, np.int64), *documents])
    hashes, found = _Hashes(words), []
    for doc, p, at, need in _grid(lengths, starts, least, periods):
        near = np.flatnonzero(words[at] == words[at + p])
        near = near[hashes.agree(at[near], p[near], need[near])]
        doc, p, at = doc[near], p[near], at[near]
        if len(near):
            right = hashes.extension(at, p, starts[doc] + lengths[doc] - at - p, True)
            left = hashes.extension(at, p, at - starts[doc], False)
            found.append(np.stack([doc, at - left, at + p + right, p, at]))
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    if not found:
        return out
    rows = np.concatenate(found, axis=1)
    rows = rows[:, np.lexsort((rows[3], rows[2], rows[1], rows[0]))]
    seen = None
    for doc, start, stop, p, at in rows.T.tolist():
        if (doc, start, stop) == seen:
            continue  # the same stretch by another grid point or a multiple of its period
        if not np.array_equal(words[start : stop - p], words[start + p : stop]):
            first = int(starts[doc])
            start, stop = _exact_extent(words, at, p, first, first + int(lengths[doc]))
            if stop - start >= max(least, periods * p):
                out[doc].append((start - first, stop - start, p))
            continue
        seen = (doc, start, stop)
        if stop - start >= max(least, periods * p):
            out[doc].append((start - int(starts[doc]), stop - start, p))
    for k, runs in enumerate(out):
        smallest: dict[tuple[int, int], int] = {}
        for start, length, p in runs:
            smallest[start, length] = min(p, smallest.get((start, length), p))
        out[k] = sorted((start, length, p) for (start, length), p in smallest.items())
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words outside runs and the first period of each, joined by one space."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join(words if keep.all() else [w for w, k in zip(words, keep.tolist()) if k])


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period; on ties the first, then of the smallest period.  Quotients
    of numbers below 2**25 are equal as doubles only if they are equal."""
    return min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False) -> DataFrame:
    """Per row the number of runs, the strongest of them, a digest of all and of the collapsed text.

    ``plant`` first rewrites documents as ``planted`` says.
    """
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(tidy(_digests(plant)), SCHEMA)


def collapse_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each text that has a run replaced by its collapsed words; other texts stay as they are."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            for pieces in _pieces([None] * len(texts), texts, False):
                for row, _, words, runs in pieces:
                    if runs:
                        texts[row] = collapsed(words, runs).decode()
            columns = list(batch.columns)
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(tidy(run), docs.schema)


def _pieces(ids: list, texts: list, plant: bool) -> Iterator[list[tuple[int, int | None, list[bytes], list]]]:
    """(row, id, words, runs) of documents that have BATCH_WORDS words together."""
    rows, codes, held = [], [], 0
    code: dict[bytes, int] = {}
    for row, (doc_id, text) in enumerate(zip(ids, texts)):
        words = (text or "").encode().split()
        found = np.array([code.setdefault(w, len(code)) for w in words], np.int64)
        if plant and len(new := planted(np.arange(len(words)), doc_id)):
            words, found = [words[k] for k in new.tolist()], found[new]
        rows.append((row, doc_id, words))
        codes.append(found)
        held += len(words)
        if held >= BATCH_WORDS or row + 1 == len(texts):
            yield [(*r, runs) for r, runs in zip(rows, find_runs(codes))]
            rows, codes, held, code = [], [], 0, {}


def _digests(plant: bool):
    sha = lambda data: hashlib.sha256(data).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            for piece in _pieces(batch.column(0).to_pylist(), batch.column(1).to_pylist(), plant):
                out = []
                for _, doc_id, words, runs in piece:
                    best = strongest(runs)
                    most = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
                    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()
                    out.append((doc_id, len(runs), *most, sha(lines), sha(collapsed(words, runs))))
                types = [pa.int64()] * 6 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return run
