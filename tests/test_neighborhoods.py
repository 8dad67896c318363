"""Set joins, retrieval, hulls, loss fields, clusters and diverse choices against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import clusters, hulls, loss_fields, retrieval, set_join, vectors
from millrace.plans import geometry_queries
from millrace.plans.registry import QUERIES

SF_DIR = "/root/testdata/sf0.001"


# Set joins


def test_similar_sets_equal_all_pairs(spark):
    rng = random.Random(3)
    left = [(k, sorted({rng.randrange(12) for _ in range(rng.randrange(1, 9))}), rng.choice((0.0, 0.3, 0.5, 0.8))) for k in range(120)]
    right = [(k, sorted({rng.randrange(12) for _ in range(rng.randrange(1, 9))}), rng.choice((0.0, 0.35, 1.0))) for k in range(90)]
    sides = [spark.createDataFrame(rows, "k long, items array<long>, floor double") for rows in (left, right)]
    counts = set_join.item_counts(*sides)
    made = [set_join.rarest_first(s, counts, ["k"]) for s in sides]
    found = {(r["l_k"], r["r_k"]): (r["overlap"], r["jaccard"]) for r in set_join.similar_sets(*made).collect()}
    wanted = {}
    for a, x, s in left:
        for b, y, t in right:
            both = len(set(x) & set(y))
            if both and both / len(set(x) | set(y)) >= max(s, t) - 1e-9:
                wanted[a, b] = (both, both / len(set(x) | set(y)))
    assert found == wanted
    shares = set_join.filter_counts(*made).first()
    assert shares["pairs_found"] == len(wanted) <= shares["after_filters"] <= shares["prefix_meetings"]


def test_classes_of_equal_sets(spark):
    rows = spark.createDataFrame([(3, [2, 1]), (1, [1, 2]), (2, [5]), (4, [])], "k long, items array<long>")
    made, members = set_join.classes(rows, "k", "items")
    assert sorted((r["class"], r["items"]) for r in made.collect()) == [(1, [1, 2]), (2, [5])]
    assert sorted((r["k"], r["class"]) for r in members.collect()) == [(1, 1), (2, 2), (3, 1)]


def test_queries_against_rows_equal_products(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(5)
    q, r = rng.normal(size=(9, 4)), rng.normal(size=(30, 4))
    r[3] = r[4]
    sides = [spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "id long, vector array<double>") for m in (q, r)]
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    near = np.round(unit(q) @ unit(r).T, 8)
    query = sides[0].withColumnRenamed("id", "query_id")
    found = {(x["query_id"], x["id"]) for x in vectors.within(query, sides[1], 0.2).collect()}
    assert found == {(int(a), int(b)) for a, b in zip(*np.nonzero(near >= 0.2))}
    top = {(x["query_id"], x["id"]) for x in vectors.within(query, sides[1], k=3).collect()}
    assert top == {(a, b) for a in range(9) for b in sorted(range(30), key=lambda b: (-near[a, b], b))[:3]}


# Retrieval


@pytest.mark.parametrize("measure, floor", [("f_beta", None), ("f_beta", 0.4), ("overlap", None)])
def test_search_equals_scoring_everything(spark, tmp_path, measure, floor):
    rng = random.Random(11)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    entries = {k: {rng.choice(words) for _ in range(rng.choice((2, 5, 9, 30, 70)))} for k in range(150)}
    asked = {k: {rng.choice(words) for _ in range(rng.randrange(1, 12))} for k in range(40)} | {99: {"absent"}}
    table = lambda sets, key: spark.createDataFrame([(k, w) for k, s in sets.items() for w in s], f"{key} long, token string")
    index = retrieval.build_index(table(entries, "id"), str(tmp_path / "index"))
    found = {}
    for r in retrieval.search(table(asked, "query_id"), index, 5, measure=measure, floor=floor).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    for q, tokens in asked.items():
        scored = []
        for e, held in entries.items():
            both = len(tokens & held)
            if both:
                scored.append((float(both) if measure == "overlap" else round(1.25 * both / (0.25 * len(tokens) + len(held)), 8), e))
        scored.sort(key=lambda x: (-x[0], x[1]))
        wanted = [(n + 1, e, s) for n, (s, e) in enumerate(scored) if n < 5 or (floor is not None and s >= floor)]
        assert [(a, b, pytest.approx(c, abs=2e-8)) for a, b, c in sorted(found.get(q, []))] == wanted


# Hulls


def plain_distance(points, x, y):
    """Distance of a point from the hull of points: inside a triangle, else the nearest segment."""
    turn = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    for a in points:
        for b in points:
            for c in points:
                if turn(a, b, c) > 0 and min(turn(a, b, (x, y)), turn(b, c, (x, y)), turn(c, a, (x, y))) >= 0:
                    return 0.0
    best = math.inf
    for a in points:
        for b in points:
            dx, dy = b[0] - a[0], b[1] - a[1]
            t = min(1, max(0, ((x - a[0]) * dx + (y - a[1]) * dy) / (dx * dx + dy * dy))) if (dx or dy) else 0
            best = min(best, math.hypot(x - a[0] - t * dx, y - a[1] - t * dy))
    return best / hulls.GRID


def point_sets():
    rng = random.Random(2)
    for g in range(40):
        n = rng.randrange(1, 8)
        yield g, [(rng.randrange(6) * 10**7, rng.randrange(6) * 10**7) for _ in range(n)]
    yield 40, [(k * 10**7, k * 10**7) for k in range(5)]
    yield 41, [(5, 5)] * 3


def test_hulls_merge_and_measure(spark, monkeypatch):
    monkeypatch.setattr(hulls, "HELD_POINTS", 20)
    monkeypatch.setattr(hulls, "CELLS", 60)
    sets = dict(point_sets())
    rows = [(g, x, y) for g, p in sets.items() for x, y in p] + [(None, 1, 1), (7, None, 3)]
    made = hulls.hulls(spark.createDataFrame(rows, "g long, x long, y long").repartition(6), "g")
    found = {r["g"]: list(zip(r["xs"], r["ys"])) for r in made.collect()}
    assert found.keys() == sets.keys()
    for g, hull in found.items():
        assert hull == hulls.convex_hull(sets[g])
        for p in sets[g]:
            others = [q for q in set(sets[g]) if q != p]
            assert (p in hull) == (not others or plain_distance(others, *p) > 0)
    box = ((0.1, 0.15, 0.3), (0.3, 0.35, 0.6))
    at = hulls.box_points(*box)
    for r in hulls.against_box(made, "g", *box).collect():
        far = [plain_distance(sets[r["g"]], x, y) for x, y in at]
        assert r["distance"] == pytest.approx(min(far), abs=1e-6)
        assert r["share_inside"] == pytest.approx(sum(d <= 1e-4 for d in far) / len(far))


def test_boundaries_equal_scalar_bisection():
    rng = np.random.default_rng(8)
    hull = np.array(hulls.convex_hull([tuple(p) for p in rng.integers(0, hulls.GRID, (12, 2)).tolist()]))
    at, rays = np.tile(np.floor(hull.mean(axis=0)), (20, 1)), rng.normal(size=(20, 2)) * hulls.GRID
    xs, ys = (np.tile(hull[:, k], (20, 1)) for k in (0, 1))
    ways = hulls.boundary_ways(xs, ys, at, rays)
    points = [tuple(v) for v in hull.tolist()]
    for (x, y), ray, way in zip(at, rays, ways):
        inside = lambda w: plain_distance(points, round(x + w * ray[0]), round(y + w * ray[1])) <= 1 / hulls.GRID
        low, high = 0.0, 400.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if inside(middle) else (low, middle)
        assert way == pytest.approx(low, rel=1e-6)


def test_targets_lie_where_they_say(spark):
    made = {r["recipe_id"]: list(zip(r["xs"], r["ys"])) for r in geometry_queries._recipe_hulls(spark, SF_DIR).collect()}
    rows = QUERIES["v21_targets"](spark, SF_DIR).collect()
    assert {tuple(r) for r in rows} == {tuple(r) for r in QUERIES["v21_targets"](spark, SF_DIR).repartition(3).collect()}
    assert {r["kind"] for r in rows} == {"close", "edge", "outside"}
    for r in rows[:600]:
        far = plain_distance(made[r["recipe_id"]], r["x"], r["y"])
        assert far <= (0.5 if r["kind"] == "outside" else 1e-6)
    wide = [r for r in rows if r["kind"] == "outside" and len(made[r["recipe_id"]]) > 3]
    assert sum(plain_distance(made[r["recipe_id"]], r["x"], r["y"]) > 0 for r in wide) > 0.9 * len(wide)


def test_source_hulls_hold_all_points(spark):
    from millrace.plans.tables import recipe_lines

    points = recipe_lines(spark, SF_DIR).join(geometry_queries._shares(spark, SF_DIR), "food_id").select(F.when(F.col("status") == "A", 0).when(F.col("status") == "N", 1).otherwise(2).alias("kind"), "x", "y").distinct().collect()
    found = {(r["kind"], r["x"], r["y"]) for r in QUERIES["v19_source_hulls"](spark, SF_DIR).collect()}
    assert found == {(k, *v) for k in range(3) for v in hulls.convex_hull([(r["x"], r["y"]) for r in points if r["kind"] == k])}


# Loss fields


def test_box_minima_equal_a_scan(spark):
    rng, steps = random.Random(4), 13
    lattice = [(i, j, rng.choice((0.25, 0.5, 0.75, 1.0))) for i in range(steps + 1) for j in range(steps + 1 - i) if rng.random() < 0.8]
    bounds = lambda: sorted((rng.randrange(-2, steps + 3), rng.randrange(-2, steps + 3)))
    boxes = [(k, *bounds(), *bounds(), *bounds()) for k in range(80)] + [(80, 0, steps, 0, steps, 0, steps), (81, 5, 5, 5, 5, 0, steps)]
    names = "box_id long, p_low int, p_high int, c_low int, c_high int, f_low int, f_high int"
    minima = loss_fields.block_minima(spark.createDataFrame(lattice, "i int, j int, loss double"), steps)
    found = {r["box_id"]: (r["loss"], r["i"], r["j"]) for r in loss_fields.box_minima(spark.createDataFrame(boxes, names), minima, steps).collect()}
    wanted = {}
    for k, p0, p1, c0, c1, f0, f1 in boxes:
        inside = [(v, i, j) for i, j, v in lattice if p0 <= i <= p1 and c0 <= j <= c1 and f0 <= steps - i - j <= f1]
        if inside:
            wanted[k] = min(inside)
    assert found == wanted


# Clusters


def blobs(n, dims=5, seed=1):
    rng = np.random.default_rng(seed)
    return [(k, (rng.normal(size=dims) * 0.3 + np.eye(dims)[k % dims]).tolist()) for k in range(n)]


def rows_of(spark, data):
    extra = [(900, None), (901, [0.0] * 5)]
    return clusters.units(spark.createDataFrame(data + extra, "id long, v array<double>"), "id", "v").repartition(3).cache()


def test_kmeans_equals_a_plain_loop(spark):
    rows = rows_of(spark, blobs(160))
    held = {r["key"]: np.array(r["unit"]) for r in rows.collect()}
    assert sorted(held) == list(range(160))
    start = clusters.seeds(rows, 6, seed=3)
    assert len(start) == 6 and np.array_equal(start, clusters.seeds(rows.repartition(5), 6, seed=3))
    start[5] = -start[0]  # may stay empty
    keys, x = sorted(held), np.array([held[k] for k in sorted(held)])
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    centres, last = start.astype(float), None
    while True:
        number = np.round(unit(x.astype(float)) @ unit(centres).T, 9).argmax(axis=1)
        if last is not None and np.array_equal(number, last):
            break
        last = number
        centres = np.array([x[number == c].sum(axis=0) if (number == c).any() else centres[c] for c in range(6)], float)
    found = clusters.spherical_kmeans(rows, start)
    assert np.array_equal(found, centres)
    assert {r["key"]: r["cluster"] for r in clusters.assign(rows, found).collect()} == dict(zip(keys, number.tolist()))
    with pytest.raises(RuntimeError, match="no fixed point"):
        clusters.spherical_kmeans(rows, start, iterations=1)


def test_large_centroids_meet_rows_in_blocks(spark, monkeypatch):
    rows, centres = rows_of(spark, blobs(60)), clusters.seeds(rows_of(spark, blobs(60)), 4)
    small = {(r["key"], r["cluster"]) for r in clusters.assign(rows, centres).collect()}
    sums = clusters._sums(rows, centres)
    monkeypatch.setattr(clusters, "BROADCAST_BYTES", 8)
    assert {(r["key"], r["cluster"]) for r in clusters.assign(rows, centres).collect()} == small
    assert np.array_equal(clusters._sums(rows, centres), sums)


def test_core_sets_come_near_the_greedy_choice(spark):
    """The least distance between chosen points is at least half of what greedy over all rows reaches."""
    rows = rows_of(spark, blobs(400, seed=6))
    held = {r["key"]: np.array(r["unit"], float) for r in rows.collect()}

    def spread(keys):
        x = np.array([held[k] / np.linalg.norm(held[k]) for k in keys])
        return (1 - x @ x.T + 9 * np.eye(len(x))).min()

    alone = [r["key"] for r in clusters.diverse(rows, 12).orderBy("pick").collect()]
    parts = [r["key"] for r in clusters.diverse(rows, 12, cell_rows=60).orderBy("pick").collect()]
    keys = np.array(sorted(held))
    x = np.array([held[k] for k in keys])
    plain = keys[clusters.pick_diverse(keys, x, np.zeros(len(x)), 12, 0.0, x.sum(axis=0))].tolist()
    assert alone == plain and len(set(parts)) == 12
    assert spread(parts) >= 0.5 * spread(plain)


def test_relevance_and_few_rows(spark):
    rows = rows_of(spark, blobs(10))
    liked = spark.createDataFrame([(4, 1.0), (7, 0.9)], "key long, relevance double")
    found = [r["key"] for r in clusters.diverse(rows, 3, weight=0.95, relevance=liked).orderBy("pick").collect()]
    assert found[:2] == [4, 7]
    assert clusters.diverse(rows, 30).count() == 10
    assert len(clusters.seeds(rows.where("false"), 3)) == 0
    with pytest.raises(ValueError, match="cells"):
        clusters.diverse(rows, 30, cell_rows=50)


def test_sample_has_two_tiers(spark):
    rows = QUERIES["p4_diverse_sample"](spark, SF_DIR).collect()
    assert sorted(r["tier"] for r in rows) == ["diverse"] * 7 + ["rare"] * 3
    assert len({r["cluster"] for r in rows}) == 10


def test_kmeans_runs_on_to_its_fixed_point(spark):
    rng = np.random.default_rng(9)
    rows = rows_of(spark, [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(8000, 8)))]).localCheckpoint()
    start = np.rint(rng.normal(size=(12, 8)) * (1 << clusters.UNIT_BITS))
    x = np.array([r["unit"] for r in rows.orderBy("key").collect()], np.int64)
    plain, last, rounds = start, None, 0
    while True:
        number = clusters.nearest(x.astype(float), plain)[0]
        sums = np.array([x[number == k].sum(axis=0) for k in range(12)])
        if last is not None and np.array_equal(sums, last):
            break
        plain, last, rounds = np.where(sums.any(axis=1, keepdims=True), sums, plain), sums, rounds + 1
    assert rounds > 100  # more than the rounds that were the limit
    assert np.array_equal(clusters.spherical_kmeans(rows, start), plain)


def test_corridor_equals_a_scan_without_sorts(spark):
    rng, steps = random.Random(5), 13
    low = [(i, j, 0.5, 0.5) for i in range(steps + 1) for j in range(steps + 1 - i) if rng.random() < 0.3]
    bounds = lambda: sorted((rng.randrange(-2, steps + 3), rng.randrange(-2, steps + 3)))
    boxes = [(k, *bounds(), *bounds(), *bounds()) for k in range(60)]
    made = loss_fields.corridor(spark.createDataFrame(boxes, "box_id long, p_low int, p_high int, c_low int, c_high int, f_low int, f_high int"), spark.createDataFrame(low, "i int, j int, loss double, threshold double"), steps)
    gap = lambda x, a, b: max(a - x, x - b, 0)
    wanted = {k: min((gap(i, a, b) + gap(j, c, d) + gap(steps - i - j, e, f), i, j) for i, j, *_ in low) for k, a, b, c, d, e, f in boxes}
    assert {r["box_id"]: (r["distance"], r["i"], r["j"]) for r in made.collect()} == wanted
    assert "Sort" not in made._jdf.queryExecution().sparkPlan().toString()


def test_shown_scores_round_as_sql_does(spark):
    import duckdb

    from millrace.plans.retrieval_queries import _shown

    pairs = [(o, n, s) for o in range(1, 21) for n in range(o, 40) for s in range(o, 120)]
    scores = [(round(1.25 * o / (0.25 * n + s), 8),) for o, n, s in pairs]
    con = duckdb.connect()
    wanted = [r[0] for r in con.execute("SELECT round(x, 6) FROM (SELECT unnest($1::DOUBLE[]) AS x)", [[x for x, in scores]]).fetchall()]
    rows = spark.createDataFrame([(k, x) for k, (x,) in enumerate(scores)], "k int, score double")
    assert [r["s"] for r in rows.select("k", _shown("score").alias("s")).orderBy("k").collect()] == wanted


def test_neighbours_of_many_blocks_equal_one_product(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 20)
    monkeypatch.setattr(vectors, "PAIR_BLOCKS", 3)
    monkeypatch.setattr(vectors, "PAIR_ROWS", 100)
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(110, 6)), np.zeros((1, 6))])
    x[7] = x[3]
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vector array<double>")
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    near = np.round(unit @ unit.T, 6)
    wanted = {k: [(-s, m) for s, m in sorted((-near[k, m], m) for m in range(len(x)) if m != k and near[k, m] >= 0.3)[:4]] for k in range(len(x))}
    found = {k: [] for k in wanted}
    for r in vectors.neighbours(table, 4, 0.3).orderBy("id", F.desc("similarity"), "match").collect():
        found[r["id"]].append((r["similarity"], r["match"]))
    assert found == wanted
    plan = vectors.neighbours(table, 4, 0.3)
    assert "sequence(a" in plan._jdf.queryExecution().optimizedPlan().toString()  # each unordered pair of blocks once
