"""Fuzzy ratios against plain tables and rules; the dedup plan on small groups."""

import difflib
import random

import pytest

from millrace.functions import fuzzy
from millrace.operators import dedup_plan
from millrace.plans.fuzzy_queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def slow_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[-1]))
        row = new
    return row[-1]


def slow_ratio(a, b):
    """Ratios of whole texts by insertions and deletions, the best of the three."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    join = lambda *sets: " ".join(" ".join(sorted(s)) for s in sets if s)
    both, left, right = join(x & y), join(x & y, x - y), join(x & y, y - x)
    ratio = lambda p, q: 200 * slow_subsequence(p, q) / (len(p) + len(q))
    return max([ratio(left, right), *((ratio(both, left), ratio(both, right)) if both else ())])


def test_subsequence_equals_the_table():
    dice = random.Random(5)
    for _ in range(300):
        a, b = ("".join(dice.choices("abc é", k=dice.randrange(90))) for _ in range(2))
        assert fuzzy.common_subsequence(a, b) == slow_subsequence(a, b)


def test_token_set_equals_the_best_of_whole_ratios(spark):
    dice = random.Random(6)
    words = ["oat", "oats", "rye", "red", "reed", "plum", "plumb"]
    pairs = [tuple(" ".join(dice.choices(words, k=dice.randrange(5))) for _ in range(2)) for _ in range(200)]
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)] + [(900, None, "x"), (901, None, None)], "k long, a string, b string")
    found = {r["k"]: r["r"] for r in rows.select("k", fuzzy.token_set_ratio("a", "b").alias("r")).collect()}
    assert found[900] == found[901] == 0
    for k, (a, b) in enumerate(pairs):
        assert found[k] == pytest.approx(slow_ratio(a, b))


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("fuzzy was a bear", "fuzzy fuzzy was a bear", 100.0), ("red oats", "oats", 100.0), ("abc", "abd", 200 / 3), ("oats red", "oats rye", 100 * (1 - 2 / 16)), ("", "x", 0.0)],
)
def test_token_set_literals(a, b, want):
    assert fuzzy.token_set_percent(a, b) == pytest.approx(want)


def test_label_scores_equal_the_rules(spark):
    names = {r["p_partkey"]: r["p_name"] for r in spark.read.parquet(f"{SF_DIR}/part.parquet").collect()}
    for r in QUERIES["st22_label_scores"](spark, SF_DIR).collect():
        t, s = r["term"], names[r["food_id"]]
        part = len(t) / len(s)
        want = 1.0 if t == s else 0.92 + 0.08 * part if s.startswith(t) else 0.75 + 0.2 * part if t in s else difflib.SequenceMatcher(None, t, s).ratio()
        assert r["score"] == pytest.approx(want, abs=1e-6)


ROWS = "id long, items array<string>, title string, n_items int, n_directions int"


def test_plan_keeps_one_row_of_each_group(spark):
    words = ["a", "b", "c", "d"]
    rows = spark.createDataFrame(
        [(1, words, "plum tart", 4, 10), (2, words, "tart plum", 5, 1), (3, words, "plum tart", 5, 7), (4, words, "rye bread", 9, 9), (5, ["z"], "plum tart", 1, 1), (6, None, None, None, None)], ROWS
    )
    near = spark.createDataFrame([(1, 2, 0.99), (2, 1, 0.99), (2, 3, 0.95), (3, 4, 0.93), (1, 5, 0.99), (1, 6, 0.99), (4, 1, 0.5), (1, 1, 1.0), (1, 77, 1.0)], "id long, match long, similarity double")
    valid = dedup_plan.valid_pairs(dedup_plan.unordered(near), rows)
    assert sorted((r["a"], r["b"]) for r in valid.collect()) == [(1, 2), (2, 3)]
    found = {r["id"]: (r["component"], r["keeper"], r["kept"]) for r in dedup_plan.plan(rows, valid).collect()}
    assert found == {1: (1, 3, False), 2: (1, 3, False), 3: (1, 3, True), 4: (4, 4, True), 5: (5, 5, True), 6: (6, 6, True)}
    assert dedup_plan.plan(rows, valid.where("false")).where("kept").count() == 6
    assert dedup_plan.plan(rows.where("false"), valid).count() == 0
