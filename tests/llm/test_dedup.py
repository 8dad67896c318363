"""Exact and near duplicates against brute force."""

import random

import numpy as np
import pytest

from millrace.llm import exact_dedup, fingerprints, near_dup
from millrace.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import connection, same

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same(QUERIES[name](spark, SF_DIR), connection(SF_DIR), ORACLE_SQL[name])


def brute_groups(rows, percent):
    """{id: (size, least id reachable)} from all pairs of shingle sets."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for name, text in rows:
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").translate(fold)) if w]
        sets[name] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {name: name for name in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {name: (len(sets[name]), find(name)) for name in names}


def near_rows():
    rng, words = random.Random(5), [f"w{k}" for k in range(300)]
    rows = [(1000, None), (1001, ""), (1002, " \t "), (1003, "one two"), (1004, "One  TWO"), (1005, "ünï Ünï x y z q")]
    base = [rng.choice(words) for _ in range(120)]
    for k in range(300):  # one large group: chains of edits around the threshold
        text = list(base)
        for _ in range(rng.randrange(5)):
            text[rng.randrange(120)] = rng.choice(words)
        rows.append((k, " ".join(text)))
    rows += [(300 + k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 400)))) for k in range(60)]
    rows += [(400 + k, rows[6 + k][1]) for k in range(40)]
    return rows


def test_near_groups_equal_brute_force(spark):
    rows = near_rows()
    docs = spark.createDataFrame([(t, n, 1) for n, t in rows], "text string, doc_id long, bucket int")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_groups(docs, 80).collect()}
    assert found == brute_groups(rows, 80)


def test_near_dedup_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op5_near_dedup"](spark, SF_DIR).collect()}
    assert found == brute_groups(rows, 85)


def test_near_null_ids_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    rows = near_dup.near_groups(docs).collect()
    assert len(rows) == 3 and all(r["kept"] for r in rows)
    assert near_dup.near_groups(docs.where("false")).count() == 0
    assert near_dup.drop_near_copies(docs).count() == 3


def test_odd_sketches_follow_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64))
    b = np.unique(np.concatenate([a[:950], rng.integers(0, 2**63, 50).astype(np.uint64)]))
    bits = lambda x, y: int(np.bitwise_count((x ^ y).view(np.uint64)).sum())
    x, y = near_dup.odd_sketch(near_dup.minhash(a)), near_dup.odd_sketch(near_dup.minhash(b))
    assert bits(x, x) == 0 and bits(x, y) <= near_dup.sketch_cut(0.85)
    fine = near_dup.fine_sketch(a)[1], near_dup.fine_sketch(b)[1]
    assert bits(*fine) <= len(np.setxor1d(a, b))


def test_exact_copies_keep_clashing_columns(spark):
    docs = spark.createDataFrame([(2, "a  b", 7), (1, "a b", 8), (3, None, 9), (4, "", 10), (None, "a\tb", 11)], "doc_id long, text string, sha int")
    assert sorted(r["doc_id"] for r in exact_dedup.drop_exact_copies(docs).collect()) == [1, 3]
    assert exact_dedup.drop_exact_copies(docs).columns == docs.columns
    groups = {r["text_sha256"]: r["group_size"] for r in exact_dedup.exact_groups(docs).collect()}
    assert sorted(groups.values()) == [2, 3]
    assert exact_dedup.exact_groups(docs.where("false")).count() == 0


def test_fingerprints_of_edited_texts(spark):
    rows = [(3, "one two three four five six " * 9), (2, None), (1, "x"), (7, "α β γ δ ε ζ η θ ι κ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted(rows, reverse=True)
    found = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(docs).collect()}
    for k, (name, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert found[name]["edited_sha256"] == __import__("hashlib").sha256(edited.encode()).hexdigest()
        assert found[name]["n_chars"] == len(text)
        a, b, c = (fingerprints.sketch(x) for x in (text, edited, after))
        assert found[name]["near_edited"] == pytest.approx(fingerprints.likeness(a, b))
        assert found[name]["near_next"] == pytest.approx(fingerprints.likeness(a, c))
        assert found[name]["fingerprint"] == fingerprints.as_text(a)
    assert fingerprints.edited_fingerprints(docs.where("false")).count() == 0


def test_sketches_merge_and_contain():
    a, b = "".join(f"a{k} " for k in range(900)), "".join(f"a{k} " for k in range(4000))
    small, large = fingerprints.sketch(a), fingerprints.sketch(b)
    assert fingerprints.containment(small, large) == 1.0
    assert fingerprints.likeness(small, large) == pytest.approx(896 / 3996, abs=0.05)
    assert (fingerprints.merged(small, large) == large).all()
    assert (fingerprints.from_text(fingerprints.as_text(small)) == small).all()
