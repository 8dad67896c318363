"""Bundles, subsets, resumed loads and refreshed views against enumeration, kills and rebuilds."""

import random
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest

from millrace.operators import bundles, views
from millrace.sources import resumable


# Bundles


def candidate_rows(seed):
    rng = random.Random(seed)
    for p in range(6):
        for s in range(rng.randrange(1, 6)):
            for k in range(rng.randrange(1, 5)):
                yield p, s, 10 * s + k, rng.choice((None, rng.randrange(6))), rng.randrange(9), rng.choice(("Egg", "egg", "oil", f"x{k}{s}")), float(rng.randrange(-3, 9))


def plain_bundles(rows, most):
    out = {}
    for p in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == p), key=lambda r: (r[1], r[2]))
        clash = lambda a, b: a[1] == b[1] or (a[3] is not None and a[3] == b[3]) or a[4] == b[4] or a[5].lower() == b[5].lower()
        found = [b for n in range(1, most + 1) for b in combinations(mine, n) if not any(clash(x, y) for x, y in combinations(b, 2))]
        out[p] = sorted((-sum(r[6] for r in b), len(b), [r[2] for r in b]) for b in found)
    return out


@pytest.mark.parametrize("most, cap", [(2, None), (3, None), (3, 4), (4, 1), (3, 500)])
def test_bundles_equal_enumeration(spark, most, cap):
    rows = list(candidate_rows(most))
    table = spark.createDataFrame(rows, "problem long, slot long, id long, line int, food long, label string, score double")
    found = {}
    for r in bundles.bundles(table, most, cap).orderBy("problem", "rank").collect():
        found.setdefault(r["problem"], []).append((-r["score"], r["size"], r["ids"]))
    assert found == {p: b[:cap] for p, b in plain_bundles(rows, most).items()}


def test_problems_of_equal_candidates_are_solved_once(spark, monkeypatch):
    mine = [(s, 10 * s + k, None, 10 * s + k, f"x{k}{s}", float(k + s)) for s in range(3) for k in range(3)]
    other = [r[:5] + (r[5] + (r[1] == 0),) for r in mine]
    rows = [(p, *r) for p in range(40) for r in (other if p == 17 else mine)]
    sizes, keep = [], bundles.checkpointed

    def counted(df):
        out = keep(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(bundles, "checkpointed", counted)
    table = spark.createDataFrame(rows, "problem long, slot long, id long, line int, food long, label string, score double")
    found = {}
    for r in bundles.bundles(table, 3, 5).orderBy("problem", "rank").collect():
        found.setdefault(r["problem"], []).append((-r["score"], r["size"], r["ids"]))
    assert found == {p: b[:5] for p, b in plain_bundles(rows, 3).items()}
    assert max(sizes[2:]) <= 2 * 27  # two classes; what comes before are all candidates and the members


# Subsets


def plain_best(nodes, ancestors, recipes):
    """The best antichain by trying all subsets, scores as fractions."""
    best = None
    for n in range(1, len(nodes) + 1):
        for chosen in combinations(sorted(nodes), n):
            held = set(chosen)
            if any(ancestors.get(x, set()) & held for x in chosen):
                continue
            score = Fraction(-1)
            if n >= bundles.LEAST_NODES:
                parts = [Fraction(len(a & b & held), len((a | b) & held)) if (a | b) & held else Fraction(1) for a, b in combinations(recipes, 2)]
                score = sum(parts) / len(parts) if parts else Fraction(1)
            key = (-score, -n, chosen)
            best = min(best, key) if best else key
    return best


def subset_tables(spark, seed, names, n_problems):
    rng = random.Random(seed)
    tree = {x: {y for y in names if y != x and x.startswith(y)} for x in names}
    data = {p: [{x for x in names if rng.random() < 0.45} for _ in range(rng.randrange(1, 7))] for p in range(n_problems)}
    rows = [(p, r, x) for p, sets in data.items() for r, held in enumerate(sets) for x in (held or {None})]
    presence = spark.createDataFrame(rows, "problem long, recipe_id long, node string")
    nodes = spark.createDataFrame([(p, x) for p in data for x in names], "problem long, node string")
    paths = spark.createDataFrame([(x, y, 1) for x, up in tree.items() for y in up] + [(x, x, 0) for x in names], "node string, ancestor string, depth int")
    return data, tree, presence, nodes, paths


def test_subsets_equal_trying_all(spark, monkeypatch):
    monkeypatch.setattr(bundles, "MASKS_A_ROW", 50)
    names = ["a", "aa", "ab", "aab", "b", "ba", "c", "d", "e"]
    data, tree, *tables = subset_tables(spark, 4, names, 8)
    found = {r["problem"]: (r["nodes"], r["score"]) for r in bundles.best_subsets(*tables).collect()}
    for p, recipes in data.items():
        score, _, chosen = plain_best(names, tree, recipes)
        assert found[p] == (list(chosen), pytest.approx(float(-score), abs=1e-8))


def test_the_climb_ends_where_no_single_move_helps(spark):
    names = [a + b for a in "abcd" for b in ("", "x", "y", "z", "w")]
    data, tree, *tables = subset_tables(spark, 9, names, 3)
    found = {r["problem"]: (r["nodes"], r["score"]) for r in bundles.best_subsets(*tables).collect()}

    def rank(held, recipes):
        if len(held) < bundles.LEAST_NODES:
            return (-1.0, len(held))
        parts = [len(a & b & held) / len((a | b) & held) if (a | b) & held else 1.0 for a, b in combinations(recipes, 2)]
        return (round(sum(parts) / len(parts), 9) if parts else 1.0, len(held))

    for p, recipes in data.items():
        nodes = set(found[p][0])
        here = rank(nodes, recipes)
        assert found[p][1] == pytest.approx(here[0])
        assert not any(tree[x] & nodes for x in nodes)
        for x in names:
            trial = nodes ^ {x}
            if trial and not any(tree[y] & trial for y in trial):
                assert rank(trial, recipes) <= here


def test_exact_and_climb_agree_on_masks():
    above = np.array([0, 0b1000, 0b1000, 0], np.int64)  # nodes 1 and 2 lie below node 0
    score, mask = bundles.best_of_all(4, above, np.array([0b0111, 0b0110], np.int64), np.array([1, 1], np.int64), 0, 16)
    assert score == -1 and mask == 0b0111  # no antichain has four nodes, so the largest one stands


# Resumed loads


def test_killed_loads_go_on_without_loss_or_repeats(spark, tmp_path):
    rows = spark.range(3, 2003, 3).selectExpr("id", "id * 2 AS twice").unionByName(spark.sql("SELECT 100000L AS id, 7L AS twice"))
    wanted = sorted(tuple(r) for r in rows.collect())
    for kill in range(4):
        target, seen = str(tmp_path / f"t{kill}"), []

        class Killed(Exception):
            pass

        def stop(place):
            seen.append(place)
            if len(seen) == kill + 1:
                raise Killed

        with pytest.raises(Killed):
            resumable.load(rows, "id", target, 150, before_commit=stop)
        assert len(resumable.done(spark, target)) == kill
        part = resumable.committed(spark, target, rows.schema)
        assert part.count() == sum(resumable.done(spark, target).values()) < len(wanted)
        again = resumable.load(rows, "id", target, 150)
        assert again == len(resumable.done(spark, target)) - kill
        assert sorted(tuple(r) for r in resumable.committed(spark, target, rows.schema).collect()) == wanted
        assert resumable.load(rows, "id", target, 150) == 0
    more = rows.unionByName(spark.range(200_000, 200_050).selectExpr("id", "0L AS twice"))
    assert resumable.load(more, "id", target, 150) == 1
    assert resumable.committed(spark, target, rows.schema).count() == len(wanted) + 50


def test_ranges_hold_their_rows(spark):
    rows = spark.range(0, 1000).selectExpr("id * id AS k").unionByName(spark.sql("SELECT CAST(NULL AS LONG) AS k"))
    found = resumable.key_ranges(rows, "k", 100)
    assert found[0][0] == 0 and found[-1][1] == 999 * 999
    assert all(b[0] == a[1] + 1 for a, b in zip(found, found[1:]))
    assert all(70 < rows.where(f"k between {low} and {high}").count() < 130 for low, high in found)
    assert resumable.key_ranges(rows.where("k < 0"), "k", 10) == []


def test_many_ranges_take_few_jobs(spark, tmp_path):
    rows = spark.range(0, 3000).selectExpr("(id * 7919) % 3000 AS k", "id AS v")
    spark.sparkContext.setJobGroup("many-ranges", "")
    try:
        assert resumable.load(rows, "k", str(tmp_path / "t"), 30) > 90
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("many-ranges")
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert len(jobs) < 60
    assert sorted(tuple(r) for r in resumable.committed(spark, str(tmp_path / "t"), rows.schema).collect()) == sorted(tuple(r) for r in rows.collect())


def test_leftovers_of_a_killed_load_do_not_come_back(spark, tmp_path):
    rows, target = spark.range(0, 300), str(tmp_path / "t")

    def stop(place):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        resumable.load(rows, "id", target, 100, before_commit=stop)
    resumable.load(rows.where("id >= 200"), "id", target, 100)
    assert sorted(r["id"] for r in resumable.committed(spark, target, rows.schema).collect()) == list(range(200, 300))


def test_failing_pages_are_tried_again(spark, tmp_path):
    calls = []

    class Page:
        sparkSession = spark

        @property
        def write(self):
            calls.append(1)
            raise OSError("busy")

    with pytest.raises(OSError, match="busy"):
        resumable._write(Page(), str(tmp_path), 0, 3, 0.0, None)
    assert len(calls) == 3


# Refreshed views


def test_refresh_equals_a_rebuild_after_random_changes(spark):
    rng = random.Random(6)
    schema = "kind string, grade long, amount long, weight long"
    row = lambda: (rng.choice(("a", "b", None)), rng.randrange(3), rng.choice((None, rng.randrange(20))), rng.randrange(50))
    rows = [row() for _ in range(60)]
    args = (["kind", "grade"], ["amount", "weight"], ["weight"])
    table = lambda data: spark.createDataFrame(data, schema)
    view = views.build(table(rows), *args)
    show = lambda df: sorted(map(str, df.collect()))
    for _ in range(4):
        gone = [rows.pop(rng.randrange(len(rows))) for _ in range(rng.randrange(20))]
        came = [row() for _ in range(rng.randrange(15))]
        rows = rows + came
        before, view = view, views.refresh(view, table(came), table(gone), table(rows), *args)
        assert show(view.select(*before.columns)) == show(views.build(table(rows), *args))
        report = {r["kind"]: r["change"] for r in views.refresh_report(before, view, "kind").collect()}
        assert report == {k: sum(c[0] == k for c in came) - sum(g[0] == k for g in gone) for k in report}
        view = spark.createDataFrame(view.collect(), view.schema)
    emptied = views.refresh(view, table([]), table(rows), table([]), *args)
    assert emptied.count() == 0
