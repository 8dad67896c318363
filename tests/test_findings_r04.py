"""What the findings of the fourth round asked for."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import neighborhood, set_join
from millrace.operators.lineage import stored
from millrace.plans import neighborhood_queries

DIMENSIONS = 6
VECTOR = "recipe_id long, vector array<float>"


def made_up(seed):
    """Core, leaf sets, nodes and vectors: recipes of several problems, copies, vectors of zeros and none."""
    rng = random.Random(seed)
    leaves = {k: frozenset(rng.randrange(30) for _ in range(rng.randrange(1, 6))) for k in range(120)}
    leaves |= {120 + k: leaves[k] for k in range(40)}
    nodes = {k: {f"n{rng.randrange(5)}" for _ in range(rng.randrange(0, 7))} for k in leaves}
    core = {(p, rng.randrange(160)) for p in range(14) for _ in range(rng.randrange(1, 8))} | {(14, k) for k in range(45)}
    base = [[rng.gauss(0, 1) for _ in range(DIMENSIONS)] for _ in range(5)]
    vectors = {k: np.array([x + rng.gauss(0, 0.2) for x in rng.choice(base)], np.float32) for k in leaves if rng.random() < 0.4}
    return core, leaves, nodes, vectors | {next(iter(vectors)): np.zeros(DIMENSIONS, np.float32)}


def plain_shells(core, leaves, nodes, vectors, target_n):
    """Every recipe against every problem."""
    out = {}
    for p in {p for p, _ in core}:
        mine = [r for q, r in core if q == p]
        if len(mine) >= target_n:
            continue
        held = [vectors[r].astype(float) for r in mine if r in vectors]
        mean = np.mean(held, axis=0) if held else None
        mean = mean if mean is not None and mean @ mean > 0 else None
        counts = Counter(x for r in mine for x in nodes[r])
        anchors = {x for x, n in counts.items() if n >= max(2, math.ceil(0.25 * len(mine)))} or set(counts)
        rows = []
        for r in set(leaves) - set(mine):
            foodon = max(len(leaves[r] & leaves[c]) / len(leaves[r] | leaves[c]) for c in mine)
            cosine = 0.0
            if mean is not None and r in vectors and (norms := math.sqrt(mean @ mean) * np.linalg.norm(vectors[r].astype(float))):
                cosine = min(max(float(mean @ vectors[r].astype(float)) / norms, 0.0), 1.0)
            similarity = round(foodon if mean is None else 0.6 * foodon + 0.4 * cosine, 8)
            if similarity >= 0.35 and anchors and len(nodes[r] & anchors) >= min(2, len(anchors)):
                rows.append((-similarity, r, foodon, cosine))
        out |= {(p, r): (foodon, cosine, rank) for rank, (_, r, foodon, cosine) in enumerate(sorted(rows)[: min(60, target_n - len(mine))], 1)}
    return out


def prepared(spark, core, leaves, nodes, vectors, target_n):
    sets = set_join.rarest_first_sets(spark.createDataFrame([(k, x) for k, s in leaves.items() for x in s], "recipe_id long, leaf long"), "recipe_id", "leaf")
    named = spark.createDataFrame([(k, sorted(x)) for k, x in nodes.items()], "recipe_id long, nodes array<string>")
    held = spark.createDataFrame([(k, v.tolist()) for k, v in vectors.items()], VECTOR)
    return neighborhood.prepared(spark.createDataFrame(sorted(core), "problem long, recipe_id long"), sets.join(named, "recipe_id"), held, DIMENSIONS, target_n=target_n), held


@pytest.mark.parametrize("seed, target_n", [(1, 40), (2, 12)])
def test_shells_equal_every_pair(spark, monkeypatch, seed, target_n):
    """the bounds by sketches and the best of each block lose nothing."""
    monkeypatch.setattr(neighborhood, "MEAN_ROWS", 3)
    monkeypatch.setattr(neighborhood, "RECIPE_ROWS", 16)
    data = made_up(seed)
    problems, held = prepared(spark, *data, target_n)
    found = {(r["problem"], r["recipe_id"]): (r["foodon"], r["semantic"], r["rank"]) for r in neighborhood.shell(problems, held, target_n=target_n).collect()}
    wanted = plain_shells(*data, target_n)
    assert found.keys() == wanted.keys() and len(found) > 30
    assert all(found[k] == pytest.approx(wanted[k], abs=1e-7) for k in wanted)


def test_vectors_are_shuffled_once(spark, monkeypatch):
    """blocks of vectors meet where they are stored, and a mean passes on no more than it has room for."""
    monkeypatch.setattr(neighborhood, "MEAN_ROWS", 20)
    monkeypatch.setattr(neighborhood, "RECIPE_ROWS", 20)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(100, DIMENSIONS)).astype(np.float32)
    x[:40] = x[0] + rng.normal(size=(40, DIMENSIONS)).astype(np.float32) / 20
    rows = [(k, v.tolist(), ["a", "b"] if k % 3 else ["a"]) for k, v in enumerate(x)]
    recipes = spark.createDataFrame(rows, VECTOR + ", nodes array<string>")
    means = recipes.select(F.col("recipe_id").alias("problem"), F.col("vector").alias("mean"), F.lit(4).alias("most"), F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("anchors"))
    near = neighborhood.near_means(means, recipes, 0.9)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "CoGroup" not in plan
    found = near.collect()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    cosines = unit @ unit.T
    for k in range(100):
        wanted = sorted((-round(0.4 * cosines[k, j], 8), j) for j in range(100) if j % 3 and cosines[k, j] >= 0.9)[:4]
        got = sorted((-round(0.4 * r["semantic"], 8), r["recipe_id"]) for r in found if r["problem"] == k)
        assert [j for _, j in got[: len(wanted)]] == [j for _, j in wanted] and len(got) >= len(wanted)
    assert len(found) < 100 * 5 * 5  # by block at most; all near pairs would be more for larger blocks of copies


def test_sketches_bound_cosines(spark):
    """no pair is left out by a sketch, and the bound is close."""
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=64).astype(np.float32).tolist()) for k in range(40)] + [(40, [0.0] * 64), (41, None), (42, [float("nan")] * 64)]
    made = stored(spark.createDataFrame(rows, VECTOR).select("recipe_id", "vector", neighborhood.sketch("vector").alias("s")))
    a, b = made.alias("a"), made.alias("b")
    bound = neighborhood.greatest_cosine(F.col("a.s"), F.col("b.s")).alias("bound")
    pairs = a.crossJoin(b).select(F.col("a.recipe_id").alias("i"), F.col("b.recipe_id").alias("j"), "a.vector", F.col("b.vector").alias("other"), bound).collect()
    for r in pairs:
        if r["i"] < 40 and r["j"] < 40:
            x, y = np.array(r["vector"]), np.array(r["other"])
            exact = x @ y / math.sqrt((x @ x) * (y @ y))
            assert exact <= r["bound"] <= exact + 0.06
        else:
            assert r["bound"] is None or math.isnan(r["bound"])


def test_cooccurrence_equals_counting(spark):
    """shares from one shuffle of the neighbours."""
    rng = random.Random(7)
    rows = [(p, sorted({f"i{rng.randrange(6)}" for _ in range(rng.randrange(0, 5))})) for p in range(6) for _ in range(rng.randrange(1, 9))]
    core = {p: [] if p == 5 else rng.sample([f"i{k}" for k in range(6)], 2) for p in range(6)}
    found = neighborhood.cooccurrence(spark.createDataFrame([(p, x or None) for p, x in rows], "problem long, items array<string>"), spark.createDataFrame(list(core.items()), "problem long, core_items array<string>"))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2
    wanted = {}
    for p, items in core.items():
        mine = [set(x) for q, x in rows if q == p]
        used = [x for x in mine if set(items) <= x] or mine
        if items:
            wanted |= {(p, k): round(n / len(used), 8) for k, n in Counter(k for x in used for k in x if k not in items).items()}
    assert {(r["problem"], r["item"]): r["share"] for r in found.collect()} == wanted


def test_brands_travel_as_numbers(spark):
    """arrays of nodes are numbers in the order of the brands."""
    names = neighborhood_queries._brands(spark, "/root/testdata/sf0.001")
    assert [r["brand"] for r in names.orderBy("code").collect()] == sorted(r["brand"] for r in names.collect())
    problems, _ = neighborhood_queries._inputs(spark, "/root/testdata/sf0.001", names)
    assert {problems.recipes.schema["nodes"].dataType.simpleString(), problems.held.schema["nodes"].dataType.simpleString()} == {"array<int>"}
