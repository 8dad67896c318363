"""The language model's work: words, what training reads, exact gradients."""

import re

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import gru_lm


class Watched:
    """In place of the network: keeps what each window gets."""

    def __init__(self):
        self.windows = []

    def window(self, h, read, target, fresh, train):
        self.windows.append((read, target, fresh))
        return h, None


def test_a_long_document_does_not_train_alone():
    """Windows in which one lane runs cost nearly as much as full ones; a text of 40,000 tokens made 2,500 of them."""
    rng = np.random.default_rng(4)
    sizes = np.append(rng.integers(1, 300, 500), [40_000, gru_lm.STRETCH, gru_lm.STRETCH + 1])
    symbols = rng.integers(0, gru_lm.SYMBOLS, sizes.sum()).astype(np.uint16)
    net = Watched()
    gru_lm.run_documents(net, symbols, sizes, train=True)
    assert len(net.windows) <= (sizes.sum() / gru_lm.LANES + gru_lm.STRETCH) / gru_lm.WINDOW + 1
    # each token is a target once, after the one before it in its document
    before = np.append(gru_lm.END_SYMBOL, symbols[:-1])
    before[np.cumsum(sizes)[:-1]] = gru_lm.END_SYMBOL
    found = np.concatenate([read[target >= 0].astype(int) * 10_000 + target[target >= 0] for read, target, _ in net.windows])
    assert np.array_equal(np.sort(found), np.sort(before.astype(int) * 10_000 + symbols))
    starts = sum(int((fresh & (target >= 0)).sum()) for _, target, fresh in net.windows)
    assert starts == len(sizes) + 40_000 // gru_lm.STRETCH + 1


def test_scoring_keeps_the_state_of_long_documents():
    size = 3 * gru_lm.STRETCH
    net = Watched()
    net.window = lambda h, read, target, fresh, train: (net.windows.append(fresh) or h, np.zeros(int((target >= 0).sum()), np.float32))
    gru_lm.run_documents(net, np.zeros(size, np.uint16), np.array([size]), train=False)
    assert sum(int(fresh.sum()) for fresh in net.windows) == 1


@pytest.mark.parametrize("scale", [1, 40])
def test_output_gradients_are_exact(scale):
    """Within float32, also where logits spread widely; they were within one percent."""
    rng = np.random.default_rng(7)
    p = gru_lm.first_parameters(rng.standard_normal(gru_lm.CLASSES), rng.standard_normal(gru_lm.TOP_WORDS))
    p |= {k: p[k] * np.float32(scale) for k in ("class_weight", "word_weight", "class_bias", "word_bias")}
    goal = np.sort(rng.integers(0, gru_lm.SYMBOLS, 700))
    flat = np.append(rng.uniform(-1, 1, (700, gru_lm.HIDDEN)), np.ones((700, 1)), axis=1).astype(np.float32)
    d_flat, grad = gru_lm.Gru(p)._output_gradients(flat, goal)
    p, x = {k: v.astype(float) for k, v in p.items()}, flat[:, :-1].astype(float)

    def less_one(weight, bias, x, k):
        y = x @ weight.T + bias
        e = np.exp(y - y.max(axis=1, keepdims=True))
        e /= e.sum(axis=1, keepdims=True)
        e[np.arange(len(k)), k] -= 1
        return e

    e = less_one(p["class_weight"], p["class_bias"], x, gru_lm._class_of(goal))
    expected, d = {"class_weight": e.T @ x, "class_bias": e.sum(axis=0), "word_weight": np.zeros_like(p["word_weight"]), "word_bias": np.zeros_like(p["word_bias"])}, e @ p["class_weight"]
    for c in range(gru_lm.TOP_CLASSES):
        own, words = np.flatnonzero(goal // gru_lm.CLASS_SIZE == c), slice(c * gru_lm.CLASS_SIZE, (c + 1) * gru_lm.CLASS_SIZE)
        e = less_one(p["word_weight"][words], p["word_bias"][words], x[own], goal[own] - words.start)
        d[own] += e @ p["word_weight"][words]
        expected["word_weight"][words], expected["word_bias"][words] = e.T @ x[own], e.sum(axis=0)
    assert np.allclose(d_flat, d, rtol=1e-4, atol=1e-4 * scale)
    for k, v in expected.items():
        assert np.allclose(grad[k], v, rtol=1e-4, atol=1e-4), k


def test_words_are_split_at_ascii_white_space_only():
    texts = [None, "", " \t", "A b", "  É x Y\u0085z\x1cq \x0b\x0cend\r\n", "\x00 W\x00", "a" * 1000, "x y " * 50]
    words, many = gru_lm.split_words(pa.array(texts, pa.string()))
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    expected = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold)) for t in texts]
    assert many.tolist() == [len(x) for x in expected]
    assert words.to_pylist() == [w for x in expected for w in x]


def test_slices_hold_all_rows_in_order(monkeypatch):
    monkeypatch.setattr(gru_lm, "SLICE_BYTES", 100)
    texts = [None, "x" * 70, "", "y" * 500, None, "z" * 20] * 30
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    slices = list(gru_lm._sliced([batch, batch.slice(0, 0)]))
    assert [i for s in slices for i in s.column(0).to_pylist()] == list(range(len(texts)))
    assert max(sum(len(t or "") for t in s.column(1).to_pylist()) for s in slices) <= 600
