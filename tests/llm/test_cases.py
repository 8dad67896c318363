"""Brute-force and edge cases of the operators."""

import itertools
import time

import numpy as np
import pytest

from millrace.llm import exact_dedup, gru_lm, near_dup, packing, pii


def small_net(seed=3):
    rng = np.random.default_rng(seed)
    p = gru_lm.first_parameters(rng.standard_normal(gru_lm.CLASSES) * 0.3, rng.standard_normal(gru_lm.TOP_WORDS) * 0.3)
    return gru_lm.Gru({k: v.astype(np.float32) for k, v in p.items()})


def softmax(x):
    e = np.exp(x - x.max())
    return e / e.sum()


def document_log_probability(p, symbols):
    """One document, one step at a time, in double precision."""
    p = {k: v.astype(float) for k, v in p.items()}
    sign = lambda x: x / (1 + np.abs(x))
    H, h, read, total, sums = gru_lm.HIDDEN, np.zeros(gru_lm.HIDDEN), gru_lm.END_SYMBOL, 0.0, []
    for goal in symbols:
        g, u = p["input"] @ p["embedding"][read] + p["gate_bias"], p["recurrent"] @ h
        z, r = np.split(0.5 + 0.5 * sign(g[: 2 * H] + u[: 2 * H]), 2)
        n = sign(g[2 * H :] + r * u[2 * H :])
        h = n + z * (h - n)
        classes = softmax(p["class_weight"] @ h + p["class_bias"])
        words = [softmax(p["word_weight"][c : c + gru_lm.CLASS_SIZE] @ h + p["word_bias"][c : c + gru_lm.CLASS_SIZE]) for c in range(0, gru_lm.TOP_WORDS, gru_lm.CLASS_SIZE)]
        every = np.concatenate([*(w * classes[k] for k, w in enumerate(words)), classes[gru_lm.TOP_CLASSES :]])
        sums.append(every.sum())
        total += np.log(every[goal])
        read = goal
    assert np.allclose(sums, 1)
    return total


def test_scores_equal_a_plain_forward_pass_and_probabilities_sum_to_one():
    net, rng = small_net(), np.random.default_rng(5)
    sizes = np.array([1, 70, 7, 33, 2])
    symbols = rng.integers(0, gru_lm.SYMBOLS, sizes.sum()).astype(np.uint16)
    found = gru_lm.run_documents(net, symbols, sizes, train=False)
    cuts = np.cumsum(sizes)
    expected = [document_log_probability(net.p, symbols[b - n : b].tolist()) for b, n in zip(cuts, sizes)]
    assert np.allclose(found, expected, rtol=1e-4)


def test_gradients_equal_differences():
    net, rng = small_net(), np.random.default_rng(3)
    read, target = rng.integers(0, gru_lm.SYMBOLS, (6, 5)), rng.integers(0, gru_lm.SYMBOLS, (6, 5))
    target[4:, 4] = -1
    fresh, h = rng.random((6, 5)) < 0.2, rng.random((gru_lm.HIDDEN, 5)).astype(np.float32) - np.float32(0.5)
    _, states, kept, x = net._forward(h, read, fresh, True)
    live = np.flatnonzero(target.ravel() >= 0)
    order = np.argsort(target.ravel()[live], kind="stable")
    grad = net.gradients(states, kept, x, read, fresh, live[order], target.ravel()[live][order])
    loss = lambda: -net.window(h, read, target, fresh, False)[1].astype(float).sum()
    for name, g in grad.items():
        for at in zip(*np.unravel_index(np.argsort(-np.abs(g), axis=None)[:3], g.shape)):
            old = net.p[name][at]
            net.p[name][at] = old + np.float32(0.01)
            above = loss()
            net.p[name][at] = old - np.float32(0.01)
            below = loss()
            net.p[name][at] = old
            assert g[at] == pytest.approx((above - below) / 0.02, rel=0.05, abs=2e-3)


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    scored = lambda df: {r["doc_id"]: r for r in gru_lm.score_documents(df).collect()}
    one, four = scored(docs.coalesce(1)), scored(docs.repartition(4))
    assert one.keys() == four.keys()
    for k, r in one.items():
        assert r["base_score"] == pytest.approx(four[k]["base_score"], rel=1e-9)
        assert r["score"] == pytest.approx(four[k]["score"], rel=1e-4)


def test_packed_numbers_come_back():
    for values in (np.arange(1000, dtype=np.uint32) ** 2, np.empty(0, np.uint64), np.array([2**63], np.uint64)):
        assert (gru_lm.unpacked(gru_lm.packed(values), values.dtype, len(values)) == values).all()


def fullest(pieces, capacity):
    return max(sum(c) for k in range(len(pieces) + 1) for c in itertools.combinations(pieces, k) if sum(c) <= capacity)


def test_every_bin_is_the_fullest_that_is_left():
    rng = np.random.default_rng(8)
    for _ in range(40):
        capacity = int(rng.integers(5, 30))
        left = rng.integers(1, capacity + 1, int(rng.integers(1, 11))).tolist()
        counts = {n: left.count(n) for n in left}
        for combination, times in packing.minimum_bin_slack(counts, capacity):
            for _ in range(times):
                used = [n for n, copies in combination for _ in range(copies)]
                assert sum(used) == fullest(left, capacity)
                for n in used:
                    left.remove(n)
        assert not left


def test_near_dedup_with_repeated_ids(spark):
    a, b = " ".join(f"w{k}" for k in range(60)), " ".join(f"v{k}" for k in range(60))
    rows = [(3, a), (5, a + " x"), (5, b), (5, b), (None, a), (7, None), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dup.near_groups(docs).collect() if r["doc_id"] is not None)
    assert found == [(3, 56, 3), (5, 56, 5), (5, 56, 5), (5, 57, 3), (7, 0, 7), (7, 0, 7)]
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in near_dup.drop_near_copies(docs).collect())
    assert kept == sorted([(3, a), (5, b), (0, a), (7, ""), (7, "")])


CLASHES = ["row", "id", "sha", "maybe", "word0", "bits0", "bit0", "__word0", "__bits1", "__sha", "__gone", "text_hash", "first", "stays", "n"]


@pytest.mark.parametrize("drop", [exact_dedup.drop_exact_copies, near_dup.drop_near_copies])
def test_dedup_keeps_columns_with_clashing_names(spark, drop):
    text = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(k, text if k < 3 else f"alone {k} " + text[k:40], *range(len(CLASHES))) for k in range(5)], ["doc_id", "text", *CLASHES])
    out = drop(docs)
    assert out.columns == docs.columns
    rows = sorted(out.collect())
    assert [r["doc_id"] for r in rows] == [0, 3, 4] and all(list(r)[2:] == list(range(len(CLASHES))) for r in rows)


@pytest.mark.parametrize("unit", ["a dot ", "one dot ", "a @ ", "a (at) b ", "( ", "+1 ", "1 dot ", "john at x dot com "])
def test_personal_data_is_linear(unit):
    began = time.perf_counter()
    pii.find_personal_data(unit * (1_000_000 // len(unit)))
    assert time.perf_counter() - began < 30


def test_disguised_addresses():
    text = "write: john dot doe at example dot com or a (at) b.org, x @ y.de"
    assert [text[a:b] for _, a, b in pii.find_personal_data(text)[1]] == ["john dot doe at example dot com", "a (at) b.org", "x @ y.de"]
