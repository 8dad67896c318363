"""Toxicity, language model, packing, pieces."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from millrace.llm import gru_lm, packing, pieces, toxicity
from millrace.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"


def test_index_finds_the_exact_nearest():
    rng = np.random.default_rng(3)
    idf = rng.uniform(0.5, 6, 80)
    vectors = [tuple(sorted(set(rng.integers(0, 80, rng.integers(1, 12)).tolist()))) for _ in range(700)]
    index = toxicity.BlockMaxIndex(idf, vectors, [0] * 700, list(range(700)))
    dense = np.zeros((700, 80))
    for k, v in enumerate(vectors):
        dense[k, list(v)] = idf[list(v)]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    for q in vectors[:40]:
        want = np.sort(dense @ (dense[vectors.index(q)]))[::-1][:10]
        found, sims = index.nearest(q, 10)
        assert np.allclose(sims, want[: len(sims)]) and (len(sims) == 10 or want[len(sims)] < 1e-9)
        assert np.allclose(dense[index.names[found]] @ dense[vectors.index(q)], sims)


def test_toxicity_on_held_out_rows(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = [r for r in QUERIES["op2_toxicity"](spark, "/root/testdata/sf0.1").collect() if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    right = sum(r["predicted"] == labels[r["doc_id"]] for r in rows) / len(rows)
    hit = [r["predicted"] for r in rows if labels[r["doc_id"]] == 1]
    wrong = [r["predicted"] for r in rows if labels[r["doc_id"]] == 0]
    assert right >= 0.9 and np.mean(hit) >= 0.8 and np.mean(wrong) <= 0.08


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(1, "bad bad"), (1, "bad bad"), (2, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.score_toxicity(docs, labels).count() == 4
    assert {r["score"] for r in toxicity.score_toxicity(docs, labels.where("false")).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.where("false"), labels).count() == 0


def test_language_model_base_and_totals(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {n: [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(fold)) if w] + [None] for n, t in docs}
    out = {n: zlib.crc32(str(n).encode()) % 7 == 2 for n in tokens}
    counts = Counter(w for n in tokens if not out[n] for w in tokens[n])
    total = sum(counts.values())
    rows = QUERIES["op8_language_model"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs)
    for r in rows:
        own = tokens[r["doc_id"]]
        base = sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in own)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[r["doc_id"]], len(own), sum(counts[w] > 0 for w in own), total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)


def test_language_model_beats_its_base_on_held_out(spark):
    rows = [r for r in QUERIES["op8_language_model"](spark, "/root/testdata/sf0.1").collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_language_model_trains_on_every_training_document():
    keys = np.random.default_rng(3).integers(-(2**63), 2**63, 10_000)
    replica, turn = gru_lm.dealt(keys, 7)
    seen = np.zeros((7, gru_lm.ROUNDS), int)
    np.add.at(seen, (replica, turn), 1)  # each key has one replica and one round, all of which take part
    assert seen.sum() == len(keys) and seen.min() > 0.8 * len(keys) / seen.size


def test_language_model_beats_its_base_on_few_documents(spark):
    rows = [r for r in QUERIES["op8_language_model"](spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_language_model_edge_cases(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "a b")], "doc_id long, text string")
    assert gru_lm.score_documents(docs).count() == 4
    assert gru_lm.score_documents(docs.where("false")).count() == 0


def test_fullest_bin_first():
    made = packing.minimum_bin_slack({7: 1, 5: 2, 4: 1, 3: 2}, 10)
    assert made[0][0] in (((7, 1), (3, 1)),) and sum(n * c for combo, times in made for n, c in combo for _ in range(times)) == 7 + 10 + 4 + 6
    assert all(sum(n * c for n, c in combo) <= 10 for combo, _ in made) and len(made) == 3


def check_packing(rows, lengths):
    by_document, by_sequence = {}, {}
    for r in rows:
        by_document.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for name, total in lengths.items():
        at = 0
        own = sorted(by_document[name], key=lambda r: r["piece"])
        for k, r in enumerate(own):
            assert (r["piece"], r["start"]) == (k, at)
            assert r["length"] == 1024 or k == 0
            at += r["length"]
        assert at == total
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    return len(by_sequence)


def test_packing_query_is_whole_and_gapless(spark):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    ids = {n: [*e.ids, 2] for (n, _), e in zip(docs, made.encode_batch([t for _, t in docs], add_special_tokens=False))}
    rows = QUERIES["op1_best_fit_packing"](spark, SF_DIR).collect()
    used = check_packing(rows, {n: len(x) for n, x in ids.items()})
    assert used <= math.ceil(sum(map(len, ids.values())) / 1024) * 1.02
    for r in rows:
        own = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert r["ids_crc32"] == zlib.crc32(own)


def test_packing_edge_cases(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "word " * 5000)], "doc_id long, text string")
    rows = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert sorted(r["length"] for r in rows)[:3] == [1, 1, 1] and sum(r["length"] for r in rows if r["doc_id"] == 2) > 5000
    assert packing.pack_documents(docs.where("false"), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("parts", [1, 3])
def test_pieces_are_lossless_and_repeatable(spark, parts):
    model = public_tokenizers.path("piece_bpe_32k.model")
    texts = [None, "", " ", "a", "Hello  world", "\n\t x ", "▁ mark▁", "日本 🎉 é", "the " * 3000, "\u0000 z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    rows = {r["doc_id"]: r for r in pieces.decode(pieces.encode_sampled(docs, model, seed=4, temperature=0.5), model).collect()}
    assert all(rows[k]["decoded"] == (t or "") for k, t in enumerate(texts))
    again = {r["doc_id"]: r["ids"] for r in pieces.encode_sampled(docs.coalesce(1), model, seed=4, temperature=0.5).collect()}
    assert all(rows[k]["ids"] == again[k] for k in again)


def test_pieces_query_is_lossless(spark):
    assert QUERIES["op3_sentencepiece"](spark, SF_DIR).where("not lossless").count() == 0


def test_chunks_of_empty_texts_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(gru_lm, "CHUNK_WORDS", 100)
    docs = spark.range(1000).coalesce(1).selectExpr("id", "cast(null as string) as text", "false as held_out")
    sizes = [len(r["doc_ids"]) for r in gru_lm._chunked(docs).select("doc_ids").collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 101
