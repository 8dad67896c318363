"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

Pieces never cross a word start, so the lattice of a text is a chain of unit lattices.  Each batch
of documents is coded as numbers, cut into units, and the distinct units are filtered forward all
at once (a trie walk finds the pieces at every position; sums over incoming pieces go position by
position).  Every occurrence then draws its own segmentation backward from the filtered sums.  Each
draw depends on the seed, the row key, the unit's place in the row and the step alone: results do
not depend on partitioning, batch sizes or retries.

The vocabulary file gives merge ranks, not probabilities, so a piece weighs
``temperature * -log(rank + OFFSET)`` (Zipf's rule over the ranks), normalised.  Characters without
a piece, and a literal word-start mark, are spelled in byte pieces, so decoding gives the text back.

Defined results: null and empty texts have no pieces; rows with equal keys and texts are segmented
alike, null keys share one; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._scratch import tidy

MARK = "▁"
FIRST_BYTE = 3  # the piece of byte 0; the other bytes follow
OFFSET = 10.0
#: Characters that are coded at once.
BATCH_CHARS = 500_000

_GOLDEN, _SALT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Pieces:
    """The vocabulary as a trie in a hash table, ready for arrays."""

    def __init__(self, path: str, temperature: float) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        texts = [model.id_to_piece(k) for k in range(size)]
        normal = [k for k in range(size) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
        single = sorted({texts[k] for k in normal if len(texts[k]) == 1})
        self.code = {c: n for n, c in enumerate(single, 1)}
        self.first_byte_code = len(single) + 1
        self.alphabet = self.first_byte_code + 256
        self.mark = self.code[MARK]
        self.of_char = np.zeros(0x110000, np.int32)
        for c, n in self.code.items():
            self.of_char[ord(c)] = n
        self.of_char[ord(" ")], self.of_char[ord(MARK)] = self.mark, 0
        self.bytes = [b""] * size
        spelled = [(k, [self.code[c] for c in texts[k]]) for k in normal if all(c in self.code for c in texts[k])]
        for k, _ in spelled:
            self.bytes[k] = texts[k].replace(MARK, " ").encode()
        for b in range(256):
            spelled.append((FIRST_BYTE + b, [self.first_byte_code + b]))
            self.bytes[FIRST_BYTE + b] = bytes([b])
        weight = np.full(size, -np.inf)
        weight[[k for k, _ in spelled]] = [-np.log(max(k - FIRST_BYTE - 256, 0) + OFFSET) for k, _ in spelled]
        weight *= temperature
        self.weight = weight - np.log(np.exp(weight[np.isfinite(weight)]).sum())
        steps: dict[int, int] = {}
        ends = [-1]
        for k, codes in spelled:
            state = 0
            for c in codes:
                key = state * self.alphabet + c
                if key not in steps:
                    steps[key] = len(ends)
                    ends.append(-1)
                state = steps[key]
            ends[state] = k
        self.ends = np.array(ends, np.int32)
        self.bits = max(4, int(np.ceil(np.log2(len(steps) * 4))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.next = np.full(1 << self.bits, -1, np.int32)
        slots = self._slot(np.fromiter(steps, np.int64, len(steps)))
        for (key, state), slot in zip(steps.items(), slots.tolist()):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.keys[slot], self.next[slot] = key, state

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _GOLDEN) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The state after each code, -1 where the trie ends."""
        keys = states.astype(np.int64) * self.alphabet + codes
        slots, out = self._slot(keys), np.full(len(keys), -1, np.int32)
        todo = np.arange(len(keys))
        while len(todo):
            there = self.keys[slots[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.next[slots[todo[hit]]]
            todo = todo[~hit & (there >= 0)]
            slots[todo] = (slots[todo] + 1) & ((1 << self.bits) - 1)
        return out

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(codes, row starts) of the texts, each with a word-start mark in front; unknown
        characters as the codes of their bytes."""
        marked = [f" {t}" if t else "" for t in texts]
        chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.of_char[chars]
        starts = np.concatenate([[0], np.cumsum([len(t) for t in marked])])
        unknown = codes == 0
        if unknown.any():
            odd = chars[unknown]
            width = np.ones(len(chars), np.int64)
            width[unknown] = 1 + (odd > 0x7F) + (odd > 0x7FF) + (odd > 0xFFFF)
            spelled = np.frombuffer(odd.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
            at = np.concatenate([[0], np.cumsum(width)])
            is_byte = np.repeat(unknown, width)
            codes = np.repeat(codes, width)
            codes[is_byte] = self.first_byte_code + spelled.astype(np.int32)
            starts = at[starts]
        return codes, starts

    def sample(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece ids of all texts, ends of each text's ids, log-probabilities given the lattice)."""
        codes, row_starts = self.codes(texts)
        if not len(codes):
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64), np.zeros(len(texts))
        # units: a run of marks and what follows up to the next one; a row starts with a mark
        is_mark = codes == self.mark
        head = is_mark.copy()
        head[1:] &= ~is_mark[:-1]
        head[row_starts[:-1][np.diff(row_starts) > 0]] = True
        unit_starts = np.flatnonzero(head)
        lengths = np.diff(np.append(unit_starts, len(codes)))
        place = np.arange(len(codes)) - np.repeat(unit_starts, lengths)
        with np.errstate(over="ignore"):
            spread = _mix(np.arange(1, lengths.max() + 1).astype(np.uint64) * _SALT) | np.uint64(1)
            hashes = _mix(np.add.reduceat(_mix(codes.astype(np.uint64)) * spread[place], unit_starts) + lengths.astype(np.uint64))
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        sizes = lengths[first]
        base = np.concatenate([[0], np.cumsum(sizes)])
        text = codes[np.repeat(unit_starts[first] - base[:-1], sizes) + np.arange(base[-1])]
        unit = np.repeat(np.arange(len(first)), sizes)
        limit = base[unit + 1]
        # pieces at every position
        live, state, depth, found = np.arange(len(text)), np.zeros(len(text), np.int32), 0, []
        while len(live):
            state = self.step(state, text[live + depth])
            depth += 1
            keep = state >= 0
            live, state = live[keep], state[keep]
            piece = self.ends[state]
            hit = piece >= 0
            found.append((live[hit], np.full(hit.sum(), depth), piece[hit]))
            keep = live + depth < limit[live]
            live, state = live[keep], state[keep]
        begin, width, piece = (np.concatenate(x) for x in zip(*found))
        # node k of unit u is base[u] + u + k
        source, target = begin + unit[begin], begin + unit[begin] + width
        level = begin + width - base[unit[begin]]
        order = np.argsort(level * np.int64(len(text) + len(first) + 1) + target, kind="stable")
        source, target, piece, level = source[order], target[order], piece[order], level[order]
        alpha = np.zeros(len(text) + len(first))
        new = np.concatenate([[True], target[1:] != target[:-1]])
        node_first = np.flatnonzero(new)
        node = np.cumsum(new) - 1
        rank = np.full(len(alpha), -1, np.int64)
        rank[target[node_first]] = np.arange(len(node_first))
        weight = self.weight[piece]
        upto = np.empty(len(piece))
        edge_cuts = np.searchsorted(level, np.arange(1, level[-1] + 2))
        node_cuts = np.searchsorted(node_first, edge_cuts)
        for k in range(len(edge_cuts) - 1):
            a, b = edge_cuts[k], edge_cuts[k + 1]
            starts = node_first[node_cuts[k] : node_cuts[k + 1]] - a
            come = alpha[source[a:b]] + weight[a:b]
            most = np.maximum.reduceat(come, starts)
            own = node[a:b] - node_cuts[k]
            share = np.exp(come - most[own])
            total = np.add.reduceat(share, starts)
            alpha[target[a + starts]] = most + np.log(total)
            run = np.cumsum(share)
            before = run[starts] - share[starts]
            upto[a:b] = node[a:b] + np.minimum((run - before[own]) / total[own], 1.0)
        upto[np.append(node_first[1:], len(upto)) - 1] = np.arange(1, len(node_first) + 1)
        # every occurrence draws backward
        per_row = np.searchsorted(unit_starts, row_starts)
        row = np.repeat(np.arange(len(texts)), np.diff(per_row))
        with np.errstate(over="ignore"):
            draw = _mix(keys[row] + (np.arange(len(which)) - per_row[row]).astype(np.uint64) * _GOLDEN)
        at = base[which + 1] + which
        stop = base[which] + which
        log_probability = np.bincount(row, -alpha[at], minlength=len(texts)).astype(np.float64)
        live, taken, turn = np.arange(len(which)), [], 0
        while len(live):
            with np.errstate(over="ignore"):
                u = (_mix(draw[live] + np.uint64(turn) * _SALT) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = np.searchsorted(upto, rank[at[live]] + u, side="right")
            taken.append((live, piece[edge]))
            log_probability += np.bincount(row[live], weight[edge], minlength=len(texts))
            at[live] = source[edge]
            live = live[at[live] != stop[live]]
            turn += 1
        counts = np.bincount(np.concatenate([x for x, _ in taken]), minlength=len(which))
        ends = np.cumsum(counts)
        ids = np.empty(ends[-1], np.int32)
        for turn, (live, drawn) in enumerate(taken):
            ids[ends[live] - 1 - turn] = drawn
        return ids, np.concatenate([[0], ends])[per_row[1:]], log_probability

    def decode(self, ids: list[int]) -> str:
        """The text that the pieces spell, without the mark in front."""
        return b"".join([self.bytes[k] for k in ids])[1:].decode("utf-8", "surrogatepass")


@lru_cache(maxsize=2)
def pieces(path: str, temperature: float) -> Pieces:
    """The vocabulary, once per Python worker."""
    return Pieces(path, temperature)


def row_keys(names: list, seed: int) -> np.ndarray:
    """A 64-bit key of each row's id and the seed."""
    return np.fromiter((xxhash.xxh3_64_intdigest(f"{seed}:{name}") for name in names), np.uint64, len(names))


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        upto, chars = at, 0
        while upto < len(texts) and (upto == at or chars + len(texts[upto]) <= BATCH_CHARS):
            chars += len(texts[upto])
            upto += 1
        yield at, upto
        at = upto


def encode_sampled(docs: DataFrame, model_path: str, seed: int = 0, temperature: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, ids, ids_crc32, log_probability: one sampled segmentation per row."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = pieces(model_path, temperature)
        for batch in batches:
            keys = row_keys(batch.column(0).to_pylist(), seed)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _groups(texts):
                ids, ends, log_probability = made.sample(texts[a:b], keys[a:b])
                cuts = np.concatenate([[0], ends]).astype(np.int32)
                crc = [zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], batch.column(1)[a:b], pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids, pa.int32())), pa.array(crc, pa.int64()), pa.array(log_probability)],
                    names=["doc_id", "text", "ids", "ids_crc32", "log_probability"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        tidy(encode), "doc_id long, text string, ids array<int>, ids_crc32 long, log_probability double"
    )


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text that ``ids_col`` spells as a further column."""
    at = encoded.columns.index(ids_col)
    schema = encoded.withColumn(out_col, F.lit("")).schema

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = pieces(model_path, 1.0)
        for batch in batches:
            texts = pa.array([made.decode(ids.as_py()) if ids.is_valid else None for ids in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, out_col])

    return encoded.mapInArrow(tidy(spell), schema)
