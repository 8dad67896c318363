"""Language-model scores from a gated recurrent network in numpy, beside an add-one unigram base.

Tokens are the ASCII-lower-cased words of a text and one end.  Its gates squash by softsign.  It reads and predicts
*symbols*: the ``TOP_WORDS`` most frequent training words, a class for each group of rarer words
that begin alike, one for words that training saw once or never, and the end.  The output is
factored: a softmax over classes, then for frequent words a softmax inside their class, for rarer
ones their share of the class's training count.  The last class is shared as the base
would: weight two for each word seen once, one for all unseen words together.  So model and base
spread their probability over the same events, the V training types and one unseen type.

Counts: each chunk of documents counts its distinct words, as 64-bit hashes (two of a billion words
share one with a chance of some 3 %, which would mix their counts).  Ranges of the hash, as many as the number of
words needs, are summed over all chunks, and each chunk gets the counts of its own words back packed, so no
vocabulary is ever in one place.
Training: on every training document, each in one of ``ROUNDS`` rounds.  Documents are dealt to replicas
by a hash of their text, ``REPLICA_TOKENS`` to each, however many it takes; so the model does not
depend on how the input is partitioned.  They run in parallel lanes, windows of ``WINDOW`` tokens with
truncated backpropagation, the state carried from window to window and reset between documents; of
documents longer than ``STRETCH`` tokens each stretch has a state of its own, so that lanes end together.
After each round replicas are averaged by weight.  Output biases start from the exact counts.
Scoring: whole documents in lanes, state carried across all windows.

Defined results: null text is empty (its end is its one token); a null id is in training; repeated
rows are scored alike; of words with equal counts the lesser hash is the more frequent; a text of
any length is scored whole (its steps follow each other, so time grows with the longest text of a
task); without training documents every count is 0; an empty table gives an empty result; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._scratch import discard, materialize, tidy

TOP_WORDS, CLASS_SIZE = 4096, 64
TAIL_CLASSES = 64
HIDDEN = 24
WINDOW, SCORE_WINDOW, LANES = 16, 32, 384
#: States whose outputs are computed at once.
BLOCK = 256
#: Tokens that run in lanes together, and the longest stretch of a document that training reads with one state.
TOGETHER, STRETCH = 4_000_000, 1024
ROUNDS = 2
RATE, CLIP = 0.2, 1.0
#: Tokens of a chunk, distinct words of chunks in a shard, tokens that a replica trains on, and
#: replicas that are averaged at once.
CHUNK_WORDS, SHARD_WORDS, REPLICA_TOKENS, FAN_IN = 1_000_000, 2_000_000, 4_000_000, 32
#: Bytes of text that are split into words at once.
SLICE_BYTES = 1 << 23
LOG10 = np.log(10.0)

TOP_CLASSES = TOP_WORDS // CLASS_SIZE
UNKNOWN_CLASS, END_CLASS = TOP_CLASSES + TAIL_CLASSES, TOP_CLASSES + TAIL_CLASSES + 1
CLASSES = END_CLASS + 1
#: Symbols: top words, then one for each other class.
SYMBOLS = TOP_WORDS + TAIL_CLASSES + 2
END_SYMBOL = SYMBOLS - 1


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 7, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def tail_classes(words: list[bytes]) -> np.ndarray:
    """Rarer words that begin alike share a class, numbered from 0."""
    heads = np.array(words, "S2").view(np.uint8).reshape(-1, 2).astype(np.int64)
    return ((heads[:, 0] * 31 + heads[:, 1] * 7) % TAIL_CLASSES).astype(np.uint8)


# ---- the network --------------------------------------------------------------------------------


def first_parameters(class_log: np.ndarray, word_log: np.ndarray) -> dict[str, np.ndarray]:
    """Small random weights; output biases from the counts."""
    rng = np.random.default_rng(11)
    made = lambda *shape: (rng.standard_normal(shape) * 0.15).astype(np.float32)
    return {
        "embedding": made(SYMBOLS, HIDDEN),
        "input": made(3 * HIDDEN, HIDDEN),
        "recurrent": made(3 * HIDDEN, HIDDEN),
        "gate_bias": np.zeros(3 * HIDDEN, np.float32),
        "class_weight": made(CLASSES, HIDDEN) * np.float32(0.1),
        "class_bias": class_log.astype(np.float32),
        "word_weight": made(TOP_WORDS, HIDDEN) * np.float32(0.1),
        "word_bias": word_log.astype(np.float32),
    }


def _softsign(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place: the gates' squashing function, at a fifth of the cost of tanh."""
    size = np.abs(x)
    size += 1
    return np.divide(x, size, out=x)


def _slope(squashed: np.ndarray) -> np.ndarray:
    """The derivative of softsign where its value is ``squashed``."""
    out = np.abs(squashed)
    np.subtract(1, out, out=out)
    return np.square(out, out=out)


_PLACES, _ONES = np.arange(BLOCK), np.ones(max(CLASSES, CLASS_SIZE), np.float32)


def _tables(weight: np.ndarray, bias: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of ``groups`` equal groups of rows: what makes logits of states that end in a one, the
    weights with a column of ones, and whether the logits need no maximum.

    States lie between -1 and 1, so weights and biases bound the logits: they are moved by the greatest
    that any of a group can be, which serves all states in place of their maximum where that is near.
    """
    reach = np.abs(weight).sum(axis=1)
    high, low = (bias + reach).reshape(groups, -1).max(axis=1), (bias - reach).reshape(groups, -1).max(axis=1)
    wide = np.concatenate([weight, bias[:, None]], axis=1).reshape(groups, -1, weight.shape[1] + 1)
    wide[:, :, -1] -= high[:, None]
    logits_of = np.ascontiguousarray(wide.transpose(0, 2, 1))
    wide[:, :, -1] = 1
    return logits_of, wide, high - low < 60


def _logits(x: np.ndarray, logits_of: np.ndarray, bounded: bool) -> np.ndarray:
    """One row for each state, moved so that its greatest is at most 0 and far from vanishing."""
    y = x @ logits_of
    if not bounded:
        y -= y.max(axis=1, keepdims=True)
    return y


def _log_softmax(x: np.ndarray, logits_of: np.ndarray, bounded: bool, k: np.ndarray) -> np.ndarray:
    """The log-probability of entry ``k`` of each state."""
    y = _logits(x, logits_of, bounded)
    at = y[_PLACES[: len(k)], k]
    return at - np.log(np.exp(y, out=y) @ _ONES[: y.shape[1]])


def _add_softmax(x: np.ndarray, logits_of: np.ndarray, wide: np.ndarray, bounded: bool, d_x: np.ndarray, sums: np.ndarray) -> None:
    """Add the softmax times the weights to ``d_x``, times the states to ``sums``, a column for each weight."""
    e = _logits(x, logits_of, bounded)
    np.exp(e, out=e)
    out = e @ wide
    part = 1 / out[:, -1:]
    d_x += out[:, :-1] * part
    sums += (x * part).T @ e


def _class_of(goal: np.ndarray) -> np.ndarray:
    return np.where(goal < TOP_WORDS, goal // CLASS_SIZE, goal - TOP_WORDS + TOP_CLASSES)


def _run_sums(rows: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, the sums of their rows); equal numbers follow each other."""
    at = np.flatnonzero(np.diff(numbers, prepend=-1))
    return numbers[at], np.add.reduceat(rows, at, axis=0)


def _by_class(kind: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The classes of frequent words that occur, each with its places; ``kind`` is in order."""
    cuts = np.searchsorted(kind, np.arange(TOP_CLASSES + 1))
    for c in np.flatnonzero(np.diff(cuts)).tolist():
        for a in range(cuts[c], cuts[c + 1], BLOCK):
            yield c, slice(a, min(a + BLOCK, cuts[c + 1]))


def _rows(states: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The states at ``places`` as rows that end in a one."""
    out = np.ones((states.shape[1], len(states) + 1), np.float32)
    out[:, :-1] = states.T
    return out.take(places, axis=0)


class Gru:
    """Forward and backward over one window of lanes.  Features are rows, lanes are columns."""

    def __init__(self, parameters: dict[str, np.ndarray]) -> None:
        """parameters: the weights and, under ``seen.`` and their name, the squared gradients so far."""
        self.p = {k: v.copy() for k, v in parameters.items() if not k.startswith("seen.")}
        self.seen = {k: parameters[f"seen.{k}"].copy() if f"seen.{k}" in parameters else np.full_like(v, 1e-3) for k, v in self.p.items()}

    def all(self) -> dict[str, np.ndarray]:
        """What a further round needs."""
        return self.p | {f"seen.{k}": v for k, v in self.seen.items()}

    def _outputs(self, flat: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """Log-probabilities of ``goal`` for states ordered by class."""
        p, n, kind = self.p, len(goal), _class_of(goal)
        found = np.empty(n, np.float32)
        logits_of, _, bounded = _tables(p["class_weight"], p["class_bias"], 1)
        for a in range(0, n, BLOCK):  # blocks stay in the processor's cache
            own = slice(a, a + BLOCK)
            found[own] = _log_softmax(flat[own], logits_of[0], bounded[0], kind[own])
        logits_of, _, bounded = _tables(p["word_weight"], p["word_bias"], TOP_CLASSES)
        for c, own in _by_class(kind):
            found[own] += _log_softmax(flat[own], logits_of[c], bounded[c], goal[own] - c * CLASS_SIZE)
        return found

    def _output_gradients(self, flat: np.ndarray, goal: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Gradients by ``flat``, states ordered by goal, and by the output parameters.

        The gradient by the logits is the softmax less one at the goal.  The part of the goals is
        summed over runs of equal goals, the softmax is divided by its sum where it has few columns.
        """
        p, n, kind = self.p, len(goal), _class_of(goal)
        d_flat = -p["class_weight"].take(kind, axis=0)
        top = np.searchsorted(kind, TOP_CLASSES)
        d_flat[:top] -= p["word_weight"].take(goal[:top], axis=0)
        logits_of, wide, bounded = _tables(p["class_weight"], p["class_bias"], 1)
        classes = np.zeros_like(logits_of[0])
        for a in range(0, n, BLOCK):
            own = slice(a, a + BLOCK)
            _add_softmax(flat[own], logits_of[0], wide[0], bounded[0], d_flat[own], classes)
        logits_of, wide, bounded = _tables(p["word_weight"], p["word_bias"], TOP_CLASSES)
        words = np.zeros_like(logits_of)
        for c, own in _by_class(kind):
            _add_softmax(flat[own], logits_of[c], wide[c], bounded[c], d_flat[own], words[c])
        classes, words = classes.T, words.transpose(0, 2, 1).reshape(TOP_WORDS, -1)
        goals, taken = _run_sums(flat, goal)
        many = np.searchsorted(goals, TOP_WORDS)
        words[goals[:many]] -= taken[:many]
        kinds, taken = _run_sums(taken, _class_of(goals))
        classes[kinds] -= taken
        parts = {"class_weight": classes[:, :-1], "class_bias": classes[:, -1], "word_weight": words[:, :-1], "word_bias": words[:, -1]}
        return d_flat, {k: np.ascontiguousarray(v) for k, v in parts.items()}

    def window(self, h: np.ndarray, read: np.ndarray, target: np.ndarray, fresh: np.ndarray, train: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """(state after the window, log-probabilities of the targets that are live, row by row).

        h: (HIDDEN, lanes); read, target: symbols (steps, lanes), target -1 where a lane has ended;
        fresh: where a document begins.  With ``train``, one step of Adagrad in place of the
        log-probabilities.
        """
        h, states, kept, x = self._forward(h, read, fresh, train)
        live = np.flatnonzero(target.ravel() >= 0)
        goal = target.ravel()[live]
        order = np.argsort(goal.astype(np.uint16), kind="stable")
        if train:
            if len(goal):
                self._descend(self.gradients(states, kept, x, read, fresh, live[order], goal[order]))
            return h, None
        log_probability = np.empty(len(goal), np.float32)
        log_probability[order] = self._outputs(_rows(states, live[order]), goal[order])
        return h, log_probability

    def gradients(self, states: np.ndarray, kept: list, x: np.ndarray, read: np.ndarray, fresh: np.ndarray, places: np.ndarray, goal: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of minus the sum of the log-probabilities of a window; ``places`` hold ``goal``, in its order."""
        d_rows = np.zeros((states.shape[1], HIDDEN), np.float32)
        d_rows[places], grad = self._output_gradients(_rows(states, places), goal)
        return grad | self._back(np.ascontiguousarray(d_rows.T), kept, x, read, fresh)

    def _forward(self, h: np.ndarray, read: np.ndarray, fresh: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray, list, np.ndarray]:
        """(state after the window, all states, what ``_back`` needs of each step, inputs)."""
        p, H = self.p, HIDDEN
        steps, lanes = read.shape
        x = p["embedding"][read.ravel()]
        gates = p["input"] @ x.T
        gates += p["gate_bias"][:, None]
        states = np.empty((H, steps * lanes), np.float32)
        starts = fresh.any(axis=1)
        kept = []
        for t in range(steps):
            if starts[t]:
                h = np.where(fresh[t], np.float32(0), h)
            now = slice(t * lanes, (t + 1) * lanes)
            u = p["recurrent"] @ h
            zr = u[: 2 * H]
            zr += gates[: 2 * H, now]
            _softsign(zr)
            slope = _slope(zr) if keep else None
            zr *= np.float32(0.5)
            zr += np.float32(0.5)
            z, r, un = zr[:H], zr[H:], u[2 * H :]
            n = r * un
            n += gates[2 * H :, now]
            _softsign(n)
            new = h - n
            new *= z
            new += n
            states[:, now] = new
            if keep:
                kept.append((h, z, r, n, un, slope))
            h = new
        return h, states, kept, x

    def _back(self, d_states: np.ndarray, kept: list, x: np.ndarray, read: np.ndarray, fresh: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients through the steps of the window."""
        p, H = self.p, HIDDEN
        steps, lanes = read.shape
        d_gates = np.empty((3 * H, steps * lanes), np.float32)
        d_recurrent = np.zeros_like(p["recurrent"])
        back = np.ascontiguousarray(p["recurrent"].T)
        d_u = np.empty((3 * H, lanes), np.float32)
        d_z, d_r, d_un = d_u[:H], d_u[H : 2 * H], d_u[2 * H :]
        d_h = np.zeros((H, lanes), np.float32)
        for t in range(steps - 1, -1, -1):
            before, z, r, n, un, slope = kept[t]
            now = slice(t * lanes, (t + 1) * lanes)
            d_h += d_states[:, now]
            d_h_in, d_h = d_h, d_h * z  # what reaches the state before directly
            d_n = d_h_in - d_h
            np.multiply(d_h_in, before - n, out=d_z)
            d_n *= _slope(n)
            np.multiply(d_n, r, out=d_un)
            np.multiply(d_n, un, out=d_r)
            slope *= np.float32(0.5)
            d_u[: 2 * H] *= slope
            d_gates[: 2 * H, now] = d_u[: 2 * H]
            d_gates[2 * H :, now] = d_n
            d_recurrent += d_u @ before.T
            d_h += back @ d_u
            if fresh[t].any():
                d_h[:, fresh[t]] = 0
        order = np.argsort(read.ravel().astype(np.uint16), kind="stable")
        symbols, sums = _run_sums((d_gates.T @ p["input"]).take(order, axis=0), read.ravel()[order])
        embedding = np.zeros_like(p["embedding"])
        embedding[symbols] = sums
        return {"recurrent": d_recurrent, "gate_bias": d_gates.sum(axis=1), "input": d_gates @ x, "embedding": embedding}

    def _descend(self, grad: dict[str, np.ndarray]) -> None:
        # windows in which few lanes still run move the weights little
        scale = np.float32(1 / (WINDOW * LANES) ** 0.5)
        for k, g in grad.items():
            g *= scale
            np.clip(g, -CLIP, CLIP, out=g)
            seen = self.seen[k]
            step = g * g
            seen += step
            np.sqrt(seen, out=step)
            np.divide(g, step, out=g)
            g *= np.float32(RATE)
            self.p[k] -= g


def stretches(sizes: np.ndarray) -> np.ndarray:
    """The sizes of documents that follow each other, those of more than STRETCH tokens cut into stretches of that size and a rest."""
    many = -(-sizes // STRETCH)
    out = np.full(many.sum(), STRETCH)
    out[np.cumsum(many) - 1] = sizes - (many - 1) * STRETCH
    return out


def run_documents(net: Gru, symbols: np.ndarray, sizes: np.ndarray, train: bool) -> np.ndarray:
    """Natural log-probability of each document (its symbols one after the other in ``symbols``).

    Documents are dealt to lanes, longest first to the shortest lane; lanes that have ended drop out.
    To train, stretches of documents are dealt, so that no few lanes with long texts run on alone.
    """
    before = np.append(np.uint16(END_SYMBOL), symbols[:-1])
    before[np.cumsum(sizes)[:-1]] = END_SYMBOL
    if train:
        sizes = stretches(sizes)
    starts = np.cumsum(sizes) - sizes
    lanes: list[list[int]] = [[] for _ in range(min(LANES, len(sizes)))]
    shortest = [(0, lane) for lane in range(len(lanes))]
    for k in np.argsort(-sizes, kind="stable").tolist():
        held, lane = shortest[0]
        lanes[lane].append(k)
        heapq.heapreplace(shortest, (held + int(sizes[k]), lane))
    filled = np.array([sizes[lane].sum() for lane in lanes])
    by = np.argsort(-filled, kind="stable")
    filled, lanes = filled[by], [lanes[k] for k in by]
    owner = np.concatenate([np.repeat(lane, sizes[lane]) for lane in lanes])
    where = np.concatenate([np.concatenate([np.arange(starts[k], starts[k] + sizes[k]) for k in lane]) for lane in lanes])
    lane_start = np.cumsum(filled) - filled
    total = np.zeros(len(sizes))
    h = np.zeros((HIDDEN, len(lanes)), np.float32)
    window = WINDOW if train else SCORE_WINDOW
    for at in range(0, int(filled.max()), window):
        active = int((filled > at).sum())
        t = at + np.arange(window)[:, None]
        live = t < filled[None, :active]
        place = np.where(live, lane_start[None, :active] + t, 0)
        token = where[place]
        document = owner[place]
        fresh = (token == starts[document]) & live
        target = np.where(live, symbols[token].astype(np.int64), -1)
        read = before[token].astype(np.int64)
        h, log_probability = net.window(h[:, :active], read, target, fresh, train)
        if log_probability is not None:
            total += np.bincount(document[live], log_probability, minlength=len(sizes))
    return total


# ---- the Spark side -----------------------------------------------------------------------------


def packed(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes: high bytes are mostly zero."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, dtype: type, n: int) -> np.ndarray:
    """The inverse of ``packed`` for n numbers."""
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(data, n * size, codec="zstd"), np.uint8) if n else np.empty(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).reshape(-1).view(dtype)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of SLICE_BYTES of text, by whole documents."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy())
        cuts = [0, *(np.flatnonzero(np.diff(ends // SLICE_BYTES)) + 1).tolist(), len(batch)]
        yield from (batch.slice(a, b - a) for a, b in itertools.pairwise(cuts) if a < b)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the lower-cased words of all texts one after the other, how many each text has)."""
    listed = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words = listed.flatten()
    full = pc.not_equal(words, "")  # white space at an end leaves an empty one
    before = np.append(0, np.cumsum(full.to_numpy(zero_copy_only=False)))
    return words.filter(full), np.diff(before[listed.offsets.to_numpy()])


_CHUNKS = pa.schema(
    [("chunk", pa.int64()), ("n_words", pa.int64()), ("hashes", pa.binary()), ("tails", pa.binary()), ("seen", pa.binary()), ("n_tokens", pa.int64())]
    + [("tokens", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("training", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("keys", pa.list_(pa.int64()))]
)
_CHUNKS_DDL = "chunk long, n_words long, hashes binary, tails binary, seen binary, n_tokens long, tokens binary, doc_ids array<long>, training array<boolean>, sizes array<int>, keys array<long>"


def _chunked(docs: DataFrame) -> DataFrame:
    """One row per chunk of consecutive documents: its distinct words as 64-bit hashes with tail class
    and training count, and its documents as numbers of those words."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, index = TaskContext.get().partitionId(), 0

        def made() -> pa.RecordBatch:
            coded = pa.concat_arrays(tokens).dictionary_encode()
            words, every = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.uint32)
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
            tails = tail_classes(words)
            seen = np.bincount(every[np.repeat(training, sizes)], minlength=len(words)).astype(np.uint64)
            row = [(part << 24) | index, len(words), hashes.tobytes(), tails.tobytes(), packed(seen), len(every), packed(every), ids, training, sizes, keys]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _CHUNKS.types)], schema=_CHUNKS)

        ids, training, sizes, tokens, keys, held = [], [], [], [], [], 0
        for batch in _sliced(batches):
            words, many = split_words(batch.column(1))
            raw = batch.column(1).cast(pa.binary())
            ends = np.append(0, np.cumsum(many))
            a = 0
            while a < len(many):
                # a document without words counts too, so that chunks are bounded
                over = np.flatnonzero(held + np.cumsum(many[a:] + 1) > CHUNK_WORDS)
                b = a + int(over[0]) + 1 if len(over) else len(many)
                own = many[a:b].tolist()
                ids += batch.column(0)[a:b].to_pylist()
                training += [not out for out in batch.column(2)[a:b].to_pylist()]
                sizes += own
                tokens.append(words[ends[a] : ends[b]])
                keys += [xxhash.xxh3_64_intdigest(text.as_py() or b"", n) - (1 << 63) for text, n in zip(raw[a:b], own)]
                held += sum(own) + b - a
                if len(over):
                    yield made()
                    index += 1
                    ids, training, sizes, tokens, keys, held = [], [], [], [], [], 0
                a = b
        if ids:
            yield made()

    return docs.mapInArrow(tidy(code), _CHUNKS_DDL)


_SHARDS_DDL = "shard long, chunk long, n_words long, hashes binary, tails binary, seen binary"
_COUNTED_DDL = "shard long, chunk long, n_words long, counts binary, top_at binary, top_hashes binary, top_counts binary, types long, tokens long, hapax long, tails array<long>"


def _shards(chunks: DataFrame, shards: int) -> DataFrame:
    """The words of each chunk by range of their hash, sorted inside each."""
    width = -(-(1 << 64) // shards)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, n, hashes, tails, seen in zip(*(batch.column(k) for k in range(5))):
                n = n.as_py()
                hashes = np.frombuffer(hashes.as_py(), np.uint64)
                order = np.argsort(hashes)
                hashes, tails, seen = hashes[order], np.frombuffer(tails.as_py(), np.uint8)[order], unpacked(seen.as_py(), np.uint64, n)[order]
                cuts = [*np.searchsorted(hashes, np.array([k * width for k in range(shards)], np.uint64)).tolist(), n]
                rows = [(k, chunk.as_py(), b - a, hashes[a:b].tobytes(), packed(tails[a:b]), packed(seen[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=["shard", "chunk", "n_words", "hashes", "tails", "seen"])

    return chunks.select("chunk", "n_words", "hashes", "tails", "seen").mapInArrow(tidy(deal), _SHARDS_DDL)


def _counted(shards: DataFrame, n_shards: int) -> DataFrame:
    """Per chunk and shard the training counts of the chunk's words; per shard a row without chunk
    that holds what the model needs of it: its most frequent words, types, tokens, words seen once
    and the counts of each tail class."""
    listed = int(TOP_WORDS / n_shards + 6 * (TOP_WORDS / n_shards) ** 0.5 + 64)

    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        sizes = [r["n_words"] for r in rows]
        hashes, at = np.unique(np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in rows]), return_inverse=True)
        c = np.bincount(at, np.concatenate([unpacked(r["seen"], np.uint64, n) for r, n in zip(rows, sizes)]), len(hashes)).astype(np.int64)
        tails = np.empty(len(hashes), np.uint8)
        tails[at] = np.concatenate([unpacked(r["tails"], np.uint8, n) for r, n in zip(rows, sizes)])
        top = np.lexsort((hashes, -c))[:listed]
        top = np.sort(top[c[top] > 1])
        is_top = np.zeros(len(hashes), bool)
        is_top[top] = True
        out, begin = [], 0
        for r, n in zip(rows, sizes):
            own = at[begin : begin + n]
            begin += n
            mine = np.flatnonzero(is_top[own]).astype(np.uint32)
            out.append((r["shard"], r["chunk"], n, packed(c[own]), mine.tobytes(), hashes[own[mine]].tobytes(), None, None, None, None, None))
        per_tail = np.bincount(tails, np.where(c > 1, c, 0), TAIL_CLASSES).astype(np.int64).tolist()
        # tail counts of the listed words leave with those that become top words
        stats = (int((c > 0).sum()), int(c.sum()), int((c == 1).sum()), per_tail)
        out.append((rows[0]["shard"], None, len(top), packed(tails[top]), None, hashes[top].tobytes(), c[top].tobytes(), *stats))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        return pa.Table.from_arrays([pa.array(col, t) for col, t in zip(zip(*out), kinds)], names=[x.split()[0] for x in _COUNTED_DDL.split(", ")])

    return shards.repartition(n_shards, "shard").groupBy("shard").applyInArrow(merge, _COUNTED_DDL)


def _statistics(chunks: DataFrame, counted: DataFrame) -> dict:
    """What the model takes from all counts; of bounded size."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, tails, hashes, c in zip(*(batch.column(k) for k in range(4))):
                n = n.as_py()
                columns = [pa.array(np.frombuffer(hashes.as_py(), np.int64)), pa.array(np.frombuffer(c.as_py(), np.int64)), pa.array(unpacked(tails.as_py(), np.uint8, n).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["hash", "c", "tail"])

    by_shard = counted.where("chunk is null")
    N, V, hapax = (x or 0 for x in by_shard.agg(F.sum("tokens"), F.sum("types"), F.sum("hapax")).first())
    tail_totals = np.zeros(TAIL_CLASSES)
    for r in by_shard.select(F.posexplode("tails")).groupBy("pos").agg(F.sum("col").alias("n")).collect():
        tail_totals[r["pos"]] = r["n"]
    n_docs = chunks.agg(F.sum(F.size(F.filter("training", lambda x: x)))).first()[0] or 0
    lists = by_shard.select("n_words", "counts", "top_hashes", "top_counts").mapInArrow(tidy(listed), "hash long, c long, tail long")
    frequent = lists.orderBy(F.desc("c"), "hash").limit(TOP_WORDS).collect()
    for r in frequent:
        tail_totals[r["tail"]] -= r["c"]
    top_counts = np.zeros(TOP_WORDS)
    top_counts[: len(frequent)] = [r["c"] for r in frequent]
    per_class = top_counts.reshape(TOP_CLASSES, CLASS_SIZE)
    totals = np.concatenate([per_class.sum(axis=1), tail_totals, [hapax], [n_docs]]) + 0.5
    inside = (per_class + 1e-3) / (per_class + 1e-3).sum(axis=1, keepdims=True)
    return {
        "N": N + n_docs, "V": V + (n_docs > 0), "n_docs": n_docs, "tops": np.array([r["hash"] for r in frequent], np.int64).view(np.uint64),
        "tail_totals": np.maximum(tail_totals, 1), "hapax": hapax, "class_log": np.log(totals / totals.sum()), "word_log": np.log(inside).ravel(),
    }


_CODED_DDL = "doc_id long, training boolean, replica long, turn long, key long, size long, symbols binary, fixed double, base double, known long"


def dealt(keys: np.ndarray, replicas: int) -> tuple[np.ndarray, np.ndarray]:
    """(replica, round) that trains on the document of each key."""
    mixed = keys.view(np.uint64)
    return (mixed % np.uint64(replicas)).astype(np.int64), (mixed // np.uint64(replicas) % np.uint64(ROUNDS)).astype(np.int64)


def _coded(chunks: DataFrame, counted: DataFrame, model: dict, tasks: int, replicas: int) -> DataFrame:
    """Per document: its symbols, what of its score is fixed, its base score and known words, and the
    replica and round that train on it, which depend on its text alone."""
    N, V, n_docs, hapax = (model[k] for k in ("N", "V", "n_docs", "hapax"))
    shared = chunks.sparkSession.sparkContext.broadcast((model["tops"], model["tail_totals"]))

    def code(key, left: pa.Table, right: pa.Table) -> pa.Table:
        tops, tail_totals = shared.value
        order_of_tops = np.argsort(tops)
        sorted_tops = tops[order_of_tops]
        out = []
        for row in left.to_pylist():
            size = row["n_words"]
            hashes, tails = np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["tails"], np.uint8)
            by, c, at = np.argsort(hashes), np.empty(size, np.int64), 0
            symbol = TOP_WORDS + tails.astype(np.int64)
            for part in sorted(right.to_pylist(), key=lambda r: r["shard"]):
                n = part["n_words"]
                c[by[at : at + n]] = unpacked(part["counts"], np.int64, n)
                at += n
            fixed = np.where(c <= 1, np.log((c + 1) / (2 * hapax + 1)), np.log(np.maximum(c, 1) / tail_totals[tails]))
            symbol[c <= 1] = TOP_WORDS + TAIL_CLASSES
            if len(tops):
                at = np.minimum(np.searchsorted(sorted_tops, hashes), len(tops) - 1)
                is_top = sorted_tops[at] == hashes
                symbol[is_top], fixed[is_top] = order_of_tops[at[is_top]], 0
            tokens, sizes = unpacked(row["tokens"], np.uint32, row["n_tokens"]), np.array(row["sizes"], np.int64)
            document = np.repeat(np.arange(len(sizes)), sizes)
            total = lambda values: np.bincount(document, values[tokens], len(sizes))  # noqa: E731, B023
            one = np.log10(N + V + 1.0)
            base = total(np.log10(c + 1.0) - one) + np.log10(n_docs + 1) - one
            known = total((c > 0).astype(float)).astype(np.int64) + int(n_docs > 0)
            coded = symbol.astype(np.uint16)[tokens]
            cuts = np.cumsum(sizes)
            symbols = [np.append(coded[b - n : b], np.uint16(END_SYMBOL)).tobytes() for b, n in zip(cuts.tolist(), sizes.tolist())]
            replica, turn = dealt(np.array(row["keys"], np.int64), replicas)
            columns = (row["doc_ids"], row["training"], replica, turn, row["keys"], sizes + 1, symbols, total(fixed), base, known)
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.float64(), pa.int64())
            out.append(pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=[x.split()[0] for x in _CODED_DDL.split(", ")]))
        return pa.concat_tables(out)

    documents = chunks.select("chunk", "n_words", "hashes", "tails", "n_tokens", "tokens", "doc_ids", "training", "sizes", "keys").repartition(tasks, "chunk")
    counts = counted.where("chunk is not null").select(F.col("chunk").alias("of"), "shard", "n_words", "counts").repartition(tasks, "of")
    return documents.groupBy("chunk").cogroup(counts.groupBy("of")).applyInArrow(code, _CODED_DDL)


def _together(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Join (symbols, sizes) until they hold TOGETHER tokens."""
    symbols, sizes, held = [], [], 0
    for own, many in parts:
        symbols.append(own)
        sizes.append(many)
        held += len(own)
        if held >= TOGETHER:
            yield np.concatenate(symbols), np.concatenate(sizes)
            symbols, sizes, held = [], [], 0
    if symbols:
        yield np.concatenate(symbols), np.concatenate(sizes)


def _documents(symbols: pa.Array, sizes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(symbols.to_pylist()), np.uint16), sizes.to_numpy(zero_copy_only=False).astype(np.int64)


def _mean(parts: DataFrame, replicas: int) -> DataFrame:
    """(name, data): parameters averaged by weight, FAN_IN replicas at a time, so that no task holds more."""

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("replica")
        weight = float(rows["weight"].sum())
        total = np.zeros(len(rows["data"].iloc[0]) // 4)
        for data, w in zip(rows["data"], rows["weight"]):
            total += np.frombuffer(data, np.float32) * (w / weight)
        return pd.DataFrame({"name": rows["name"][:1], "replica": rows["replica"][:1] // FAN_IN, "data": [total.astype(np.float32).tobytes()], "weight": [weight]})

    while replicas > 1:
        parts = parts.groupBy("name", F.floor(F.col("replica") / FAN_IN).alias("group")).applyInPandas(mean, "name string, replica long, data binary, weight double")
        replicas = -(-replicas // FAN_IN)
    return parts.select("name", "data")


def _train(coded: DataFrame, start: dict[str, np.ndarray], replicas: int) -> dict[str, np.ndarray]:
    """Rounds of local training and averaging over replicas."""
    sc = coded.sparkSession.sparkContext
    now = Gru(start).all()
    for turn in range(ROUNDS):
        given = sc.broadcast(now)

        def learn(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            net, replica, weight = None, None, 0

            def result() -> pa.RecordBatch:
                out = net.all()
                columns = [pa.array(list(out)), pa.array([replica] * len(out), pa.int64()), pa.array([v.tobytes() for v in out.values()], pa.binary()), pa.array([float(weight)] * len(out))]
                return pa.RecordBatch.from_arrays(columns, names=["name", "replica", "data", "weight"])

            def runs() -> Iterator[tuple[int, pa.RecordBatch]]:
                for batch in batches:
                    own = batch.column(0).to_numpy()
                    cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
                    for a, b in zip(cuts, cuts[1:]):
                        if a < b:
                            yield int(own[a]), batch.slice(a, b - a)

            for replica, mine in itertools.groupby(runs(), key=lambda x: x[0]):  # rows come sorted by replica
                net, weight = Gru(given.value), 0
                for symbols, sizes in _together(_documents(b.column(1), b.column(2)) for _, b in mine):
                    run_documents(net, symbols, sizes, train=True)
                    weight += len(symbols)
                yield result()

        mine = coded.where((F.col("turn") == turn) & F.col("training")).select("replica", "symbols", "size", "key")
        dealt = mine.repartitionById(replicas, F.col("replica").cast("int")).sortWithinPartitions("replica", "key").select("replica", "symbols", "size")
        parts = dealt.mapInArrow(tidy(learn), "name string, replica long, data binary, weight double")
        # one row per parameter array comes to the driver: the size of the model
        means = {r["name"]: np.frombuffer(r["data"], np.float32) for r in _mean(parts, replicas).collect()}
        now = {k: means[k].reshape(v.shape) if k in means else v for k, v in now.items()}
    return {k: v for k, v in now.items() if not k.startswith("seen.")}


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held_out"))
    chunks = materialize(_chunked(texts), "chunks")
    words, tokens, n_chunks = (x or 0 for x in chunks.agg(F.sum("n_words"), F.sum("n_tokens"), F.count(F.lit(1))).first())
    n_shards, replicas = max(1, -(-words // SHARD_WORDS)), max(1, round(tokens / REPLICA_TOKENS))
    counted = materialize(_counted(_shards(chunks, n_shards), n_shards), "counted")
    model = _statistics(chunks, counted)
    coded = materialize(_coded(chunks, counted, model, max(1, n_chunks // 2), replicas), "coded")
    discard(chunks)
    discard(counted)
    net = sc.broadcast(_train(coded, first_parameters(model["class_log"], model["word_log"]), replicas))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, waiting = Gru(net.value), []

        def each() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                if len(batch):
                    waiting.append(batch.drop_columns(["symbols"]))
                    yield _documents(batch.column(3), batch.column(2))

        for symbols, sizes in _together(each()):
            rows = pa.Table.from_batches(waiting)
            waiting.clear()
            found = (run_documents(made, symbols, sizes, train=False) + rows.column("fixed").to_numpy()) / LOG10
            yield from rows.drop_columns(["fixed"]).append_column("score", pa.array(found)).combine_chunks().to_batches()

    scored = coded.select("doc_id", (~F.col("training")).alias("held_out"), F.col("size").alias("n_tokens"), "symbols", "fixed", F.col("known").alias("n_known"), F.col("base").alias("base_score"))
    return scored.mapInArrow(tidy(score), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(int(model["N"])).cast("long").alias("train_tokens"), "base_score", "score"
    )
