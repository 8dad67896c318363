"""Vector codes, periodic runs and repeated byte windows against brute force and SQL."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from millrace.llm import periodic_runs, suffix_dedup, vector_codes
from millrace.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import connection, same

SF_DIR = "/root/testdata/sf0.001"


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.mark.parametrize("name", ["op11_vector_codes", "op13_suffix_dedup"])
def test_queries_equal_sql_on_larger_tables(spark, name):
    sf_dir = "/root/testdata/sf0.01"
    same(QUERIES[name](spark, sf_dir), connection(sf_dir), ORACLE_SQL[name])


# Vector codes


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """The contract by loops over (vec_id, vector, label)."""
    kept = [(i, [int(np.floor(x * 1024)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = np.array([v for _, v, _ in kept], object)
    width = whole.shape[1] // parts
    cut = [whole[:, k * width : (k + 1) * width] for k in range(parts)]
    books = [c[:entries].copy() for c in cut]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    place = lambda x, book: min((far(x, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for c, book in zip(cut, books):
            goal = [place(x, book)[1] for x in c]
            for k in range(len(book)):
                mine = [x for x, g in zip(c, goal) if g == k]
                if mine:
                    book[k] = [sum(x[d] for x in mine) // len(mine) for d in range(width)]
    found = [[place(x, book) for x in c] for c, book in zip(cut, books)]
    digest = sha(",".join(str(v) for b in books for e in b for v in e).encode())
    rows = [(r[0], "".join(f"{f[n][1]:02x}" for f in found), sum(f[n][0] for f in found), r[2]) for n, r in enumerate(kept)]
    total = {}
    for _, _, error, label in rows:
        total[label] = total.get(label, 0) + error
    return sorted([(i, code, error, total[label], digest) for i, code, error, label in rows], key=str)


def test_vector_codes_equal_loops(spark):
    rng = random.Random(7)
    rows = [(n, [rng.gauss(0, 0.3) for _ in range(8)], n % 3 if n % 5 else None) for n in range(330)]
    rows += [(400, None, 1), (401, [None] + [0.0] * 7, 1), (402, [float("nan")] + [0.0] * 7, 1), (403, [float("inf")] + [0.0] * 7, 1)]
    rows += [(7, rows[7][1], 0), (7, rows[9][1], 2), (None, rows[11][1], None), (500, [-0.0] * 8, 9), (-3, rows[7][1], 9), (501, rows[3][1], 9)]
    vectors = spark.createDataFrame([(9, *r) for r in rows], "code int, vec_id long, embedding array<double>, label int")
    found = sorted((tuple(r) for r in vector_codes.vector_codes(vectors.repartition(7)).collect()), key=str)
    assert found == plain_codes(rows)


def test_vector_codes_of_few_no_and_uneven_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    few = [(2, [0.5, 0.25, -0.5, 1.0], None), (1, [0.5, 0.25, -0.5, 1.0], None)]
    made = vector_codes.vector_codes(spark.createDataFrame(few, schema)).collect()
    assert sorted((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in made) == [(1, "00000000", 0, 0), (2, "00000000", 0, 0)]
    assert vector_codes.vector_codes(spark.createDataFrame([], schema)).count() == 0
    assert vector_codes.vector_codes(spark.createDataFrame([(1, None, 1)], schema)).count() == 0
    with pytest.raises(ValueError, match="4 equal parts"):
        vector_codes.vector_codes(spark.createDataFrame([(1, [1.0, 2.0], 1)], schema))
    with pytest.raises(Exception, match="unequal length"):
        vector_codes.vector_codes(spark.createDataFrame([(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], schema))
    with pytest.raises(Exception, match="components beyond"):
        vector_codes.vector_codes(spark.createDataFrame([(1, [1e9] * 4, 1)], schema))


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(4)
    for most in (3, 500, 1 << 27):
        entries, queries = rng.integers(-most, most, (256, 16)), rng.integers(-most, most, (300, 16))
        exact = ((queries[None] - entries[:, None]) ** 2).sum(axis=2)
        file = vector_codes.VaFile(entries)
        lower, upper = file.bounds(queries, np.int64)
        assert (lower <= exact).all() and (exact <= upper).all()
        entry, error, refined = file.nearest(queries)
        assert (entry == exact.argmin(axis=0)).all() and (error == exact.min(axis=0)).all()
        assert refined < exact.size / 3


def test_codes_decode_to_their_entries():
    books = [np.array([[1, 2], [3, 4]]), np.array([[5, 6], [7, 8]])]
    assert vector_codes.decode("0100", books).tolist() == [3, 4, 5, 6]


# Periodic runs


def plain_runs(words, least=24, periods=3):
    found = {}
    for p in range(1, len(words) // periods + 1):
        j = 0
        while j < len(words) - p:
            if words[j] != words[j + p]:
                j += 1
                continue
            s = j
            while j < len(words) - p and words[j] == words[j + p]:
                j += 1
            if j + p - s >= max(least, periods * p):
                found.setdefault((s, j + p - s), p)
    return sorted((s, n, p) for (s, n), p in found.items())


def word_lists(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        w = [rng.randrange(rng.choice((1, 2, 3, 50))) for _ in range(rng.randrange(140))]
        if len(w) > 3 and rng.random() < 0.7:
            a, p = rng.randrange(len(w)), rng.randrange(1, max(2, len(w) // 3))
            w = [w[a + (i - a) % p] if i >= a and a + (i - a) % p < len(w) else x for i, x in enumerate(w)]
        yield np.array(w, np.int64)


def test_runs_equal_brute_force():
    for least, periods in ((24, 3), (4, 3), (6, 2)):
        docs = list(word_lists(least, 400))
        assert periodic_runs.find_runs(docs, least, periods) == [plain_runs(d.tolist(), least, periods) for d in docs]


def test_runs_do_not_rest_on_hashes(monkeypatch):
    monkeypatch.setattr(periodic_runs, "_mixed", lambda x: (x % 2).astype(np.uint64))
    docs = list(word_lists(3, 150))
    assert periodic_runs.find_runs(docs, 6, 3) == [plain_runs(d.tolist(), 6, 3) for d in docs]


def test_runs_in_small_blocks_of_pairs(monkeypatch):
    docs = list(word_lists(5, 60))
    wanted = periodic_runs.find_runs(docs)
    monkeypatch.setattr(periodic_runs, "PAIR_BLOCK", 7)
    assert periodic_runs.find_runs(docs) == wanted


def plain_digest(doc_id, text):
    words = [w for w in __import__("re").split(rb"[\x20\x09-\x0D]+", (text or "").encode()) if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = max(runs, key=lambda r: (__import__("fractions").Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    most = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *most, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone))


def test_run_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect() if len(r["text"] or "") < 30_000]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(tuple(r) for r in periodic_runs.periodic_runs(docs, plant=True).collect())
    assert found == sorted(plain_digest(*r) for r in rows)
    assert sum(r[1] for r in found) > 10
    assert QUERIES["op12_periodic_runs"](spark, SF_DIR).count() == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()


def test_run_edge_cases(spark):
    rows = [(None, "a " * 40), (None, None), (1, ""), (2, " \t\x0b\n"), (3, "a b " * 30), (3, "a b " * 30), (4, "x y " * 60_000), (5, "ab " * 23)]
    docs = spark.createDataFrame([(t, n, "other") for n, t in rows], "text string, doc_id long, start string")
    found = {(r["doc_id"], r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) for r in periodic_runs.periodic_runs(docs).collect()}
    assert found == {(None, 1, 0, 40, 1, 40_000), (None, 0, *[None] * 4), (1, 0, *[None] * 4), (2, 0, *[None] * 4), (3, 1, 0, 30, 1, 30_000), (4, 1, 0, 120_000, 2, 60_000_000), (5, 0, *[None] * 4)}
    assert periodic_runs.periodic_runs(docs.where("false")).count() == 0
    kept = {(r["doc_id"], r["text"], r["start"]) for r in periodic_runs.collapse_runs(docs).collect()}
    assert kept == {(None, "a", "other"), (None, None, "other"), (1, "", "other"), (2, " \t\x0b\n", "other"), (3, "a b", "other"), (4, "x y", "other"), (5, "ab " * 23, "other")}


# Repeated byte windows


def plain_spans(rows, depth=50):
    first, key = {}, lambda i: (i is None, i or 0)
    for i, t in rows:
        data = (t or "").encode()
        for s in range(len(data) - depth + 1):
            gram = data[s : s + depth]
            first[gram] = min(first.get(gram, key(i)), key(i))
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - depth + 1):
            if first[data[s : s + depth]] < key(i):
                gone[s : s + depth] = b"\1" * depth
        spans = sum(1 for k, x in enumerate(gone) if x and not (k and gone[k - 1]))
        out.append((i, len(data), sum(gone), spans, sha(bytes(x for x, y in zip(data, gone) if not y))))
    return sorted(out, key=str)


def repeating_rows():
    rng = random.Random(1)
    base, rows = "".join(rng.choice("abcdéf \n") for _ in range(400)), []
    for i in range(90):
        text = base
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(text))
            text = text[:k] + rng.choice("xyzß") + text[k + 1 :]
        k = rng.randrange(300)
        line = f"a common line, one that comes again {i % 7}" * rng.randrange(3)
        rows.append((rng.randrange(60) if i % 9 else None, "".join(rng.choice("ab ") for _ in range(rng.randrange(30))) + text[k : k + rng.randrange(200)] + line))
    return rows + [(200, None), (201, ""), (202, "a" * 300), (203, "a" * 49), (204, "a" * 50), (5, "a" * 120), (None, "a" * 60), (-4, "b" * 70), (6, "b" * 70)]


@pytest.mark.parametrize("block, piece, many", [(2 << 20, 1 << 20, 16), (900, 333, 1)])
def test_repeated_windows_equal_brute_force(spark, monkeypatch, block, piece, many):
    """As a whole, and with tiny blocks, slices and one group a gram."""
    rows = repeating_rows()
    docs = spark.createDataFrame([(t, n, "other") for n, t in rows], "text string, doc_id long, block string").repartition(5)
    for name, value in (("BLOCK_BYTES", block), ("SLICE_BYTES", piece), ("MANY", many)):
        monkeypatch.setattr(suffix_dedup, name, value)
    assert sorted((tuple(r) for r in suffix_dedup.repeated_spans(docs).collect()), key=str) == plain_spans(rows)


def test_other_depths_and_empty_tables(spark):
    rows = [(n, t) for n, t in repeating_rows() if n is not None][:40]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for depth in (8, 90):
        assert sorted((tuple(r) for r in suffix_dedup.repeated_spans(docs, depth=depth).collect()), key=str) == plain_spans(rows, depth)
    assert suffix_dedup.repeated_spans(docs.where("false")).count() == 0
    kept = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.kept_bytes(spark.createDataFrame([(1, "x" * 60), (2, "x" * 60 + "tail")], "doc_id long, text string")).collect()}
    assert kept == {1: b"x" * 60, 2: b"tail"}


def test_leftmost_least_place():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 4, 200).astype(np.uint64)
    for width in (1, 2, 5, 35):
        assert suffix_dedup.leftmost_least(values, width).tolist() == [k + int(values[k : k + width].argmin()) for k in range(len(values) - width + 1)]
