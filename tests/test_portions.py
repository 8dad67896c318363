"""Portion kinds, scores and the ladder to grams against the same rules row by row."""

import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import parsing
from millrace.functions.scores import GRAMS_PER_UNIT, ML_PER_UNIT
from millrace.operators import portions as po
from millrace.plans import portion_queries
from millrace.plans.registry import QUERIES
from millrace.plans.tables import raw_lines

SF_DIR = "/root/testdata/sf0.001"


def unit_name(word):
    bare = word.replace(".", "")
    return parsing.CASED_UNITS.get(bare) or parsing.UNIT_OF.get(bare.lower())


def volume_unit(text):
    found = re.search(po.VOLUME_WORD, text.lower())
    return next((u for p, u in po.VOLUME_UNITS.items() if re.fullmatch(p, found[1])), None) if found else None


def leading(text):
    found = re.match(po.LEADING_AMOUNT, text)
    if not found:
        return None
    whole, _, part = found[1].partition(" ")
    top, _, low = part.strip().partition("/")
    return float(whole) + (float(top) / float(low) if low else 0)


def plain_class(r):
    name, mod, desc = (r[c].strip() for c in ("unit_name", "modifier", "description"))
    code = mod.isdigit()
    fields = [f for f, good in ((name, name.lower() not in po.SAYS_NOTHING), (mod, not code), (desc, True)) if f and good]
    amount = r["amount"] if r["amount"] > 0 else 1.0
    out = {"ref_unit": None, "ref_amount": amount, "label": None, "readable": bool((mod and not code) or desc or name), "code": code}
    heavy = name.lower() in po.MASS_NAMES or any(re.search(po.MASS_WORD, f.lower()) and not re.search(po.FLUID_OUNCE, f.lower()) for f in fields)
    volume = next((f for f in fields if volume_unit(f)), None)
    if r["gram_weight"] <= 0:
        return out | {"kind": "other"}
    if volume:
        return out | {"kind": "volume", "ref_unit": volume_unit(volume), "ref_amount": leading(volume) or amount}
    if heavy:
        return out | {"kind": "mass"}
    for f in fields:
        counted = re.match(po.COUNTED, f.lower())
        label = None if f.isdigit() else unit_name(f) or (counted and counted[1].strip()) or (f.lower() if len(f) <= po.LABEL_LENGTH else None)
        if label:
            return out | {"kind": "count", "label": label}
    return out | {"kind": "other"}


def points(r):
    return min(r["data_points"], 50) - r["seq"] * 0.01


def texts(r):
    return (r["label"] or "").lower(), r["modifier"].strip().lower(), r["description"].strip().lower()


def has_size(r, size):
    every = " ".join(texts(r))
    return size is not None and (size in every or size.replace("-", " ") in every)


def count_score(r, unit, size):
    label, mod, desc = texts(r)
    fit = 0.0
    if unit is not None and unit not in po.SIZES:
        if label == unit:
            fit += 100
        elif unit in re.split(r"[\s,/-]+", label):
            fit += 80
        elif re.search(rf"\b{unit}\b", label):
            fit += 40
        elif re.search(rf"\b{unit}\b", mod) or re.search(rf"\b{unit}\b", desc):
            fit += 35
    if size in po.SIZES:
        if size in mod or size.replace("-", " ") in mod:
            fit += 70
        elif size in " ".join((label, mod, desc)):
            fit += 45
    return fit + points(r) if fit > 0 else 0.0


def plain_grams(line, rows):
    q, unit, size = line["quantity"], line["unit"], line["size"]
    first = lambda r: (r["seq"], -r["data_points"], r["portion_id"])
    if line["food_id"] is None:
        return None, "missing_food", None, "none"
    if line["bracketed"] is not None:
        return line["bracketed"], "ok_embedded_mass", None, "bracketed"
    if unit in GRAMS_PER_UNIT and q is not None:
        return q * GRAMS_PER_UNIT[unit], "ok_embedded_mass", None, "mass"
    if unit in ML_PER_UNIT and q is not None:
        pool = [r for r in rows if r["kind"] == "volume"]
        pool = [r for r in pool if not r["code"] or r["readable"]] or pool
        pool = [r for r in pool if r["ref_unit"] == unit] or pool
        score = lambda r: (100 * (r["ref_unit"] == unit) + 10 * (r["readable"] and not r["code"]) + 5 * (not r["code"]) + points(r))
        if pool:
            r = min(pool, key=lambda r: (-score(r), *first(r)))
            return q * ML_PER_UNIT[unit] / (r["ref_amount"] * ML_PER_UNIT[r["ref_unit"]]) * r["gram_weight"], "ok_volume_portion", r["portion_id"], "volume"
        return None, "no_portion", None, "none"
    if q is None:
        return None, "no_quantity", None, "none"
    counts = [r for r in rows if r["kind"] == "count"]
    give = lambda r, path, by_amount: (q / (r["ref_amount"] if by_amount else 1) * r["gram_weight"], "ok_count_portion", r["portion_id"], path)
    if fits := [r for r in counts if count_score(r, unit, size) > 0]:
        return give(min(fits, key=lambda r: (-count_score(r, unit, size), *first(r))), "count", True)
    if sized := [r for r in counts if has_size(r, size)]:
        return give(min(sized, key=first), "size", True)
    if size is None and all((r["label"] or "").strip() in (*po.SIZE_ONLY, "") for r in counts):
        for s in po.SIZE_LADDER:
            if rung := [r for r in counts if has_size(r, s)]:
                return give(min(rung, key=first), "size_ladder", True)
    if unit in po.CONTAINERS:
        if held := [r for r in rows if r["kind"] in ("mass", "other") and r["gram_weight"] > 0 and unit in r["modifier"].lower()]:
            return give(min(held, key=first), "container", False)
    whole = lambda r: 10 * bool(line["name"] and line["name"].lower() in r["modifier"].lower()) + 5 * bool(re.search(po.WHOLE_WORDS, r["modifier"].lower())) + 20 * bool(size and size in r["modifier"].lower())
    if items := [r for r in rows if r["kind"] == "mass" and r["modifier"].strip()]:
        return give(min(items, key=lambda r: (-whole(r), *first(r))), "whole_item", False)
    serving = lambda r: bool(re.search(po.SERVING_WORDS, " ".join(filter(None, (r["label"], r["modifier"], r["description"], r["unit_name"]))).lower()))
    if any(serving(r) for r in rows if r["kind"] in ("mass", "count")) and all(serving(r) for r in counts):
        return None, "unresolvable_serving_only", None, "none"
    return None, "no_portion", None, "none"


@pytest.fixture(scope="module")
def portion_rows(spark):
    made = [r.asDict() for r in portion_queries.food_portions(spark, SF_DIR).collect()]
    return [r | plain_class(r) for r in made]


def test_portion_kinds_equal_the_rules(spark, portion_rows):
    found = {r["portion_id"]: (r["kind"], r["ref_unit"], r["ref_amount"], r["label"], r["readable"]) for r in QUERIES["m4_portion_classes"](spark, SF_DIR).collect()}
    assert found == {r["portion_id"]: (r["kind"], r["ref_unit"], r["ref_amount"], r["label"], r["readable"]) for r in portion_rows}
    assert {r["kind"] for r in portion_rows} == {"volume", "count", "mass", "other"}


def test_grams_equal_the_ladder(spark, portion_rows):
    by_food = {}
    for r in portion_rows:
        by_food.setdefault(r["food_id"], []).append(r)
    lines = raw_lines(spark, SF_DIR).select(*portion_queries.KEY, "raw", parsing.parsed_line(F.col("raw")).alias("p"), parsing.bracketed_grams(F.col("raw")).alias("bracketed"))
    wanted, paths = {}, set()
    for r in lines.collect():
        p = r["p"]
        line = {"food_id": r["food_id"], "quantity": p["quantity"], "unit": None if p["unit"] == "each" else p["unit"], "size": p["size"], "name": p["name"], "bracketed": r["bracketed"]}
        made = plain_grams(line, by_food[r["food_id"]])
        paths.add(made[3])
        wanted.setdefault(tuple(r[k] for k in portion_queries.KEY), []).append(made)
    found = {}
    for r in QUERIES["m6_resolved_grams"](spark, SF_DIR).collect():
        found.setdefault(tuple(r[k] for k in portion_queries.KEY), []).append((r["grams"], r["status"], r["portion_id"], r["path"]))
    assert found.keys() == wanted.keys()
    for key, rows in wanted.items():
        for (g, *rest), (h, *other) in zip(sorted(rows, key=str), sorted(found[key], key=str)):
            assert rest == other and (g is None) == (h is None) and (g is None or h == pytest.approx(g, abs=1e-4)), key
    assert len(paths) > 5


def test_lines_without_food_or_amount(spark):
    rows = spark.createDataFrame([(1, 10, 0, 3, 40.0, 1.0, "medium", "", ""), (1, 11, 1, 9, 60.0, 2.0, "large", "", "")], "food_id long, portion_id long, seq int, data_points int, gram_weight double, amount double, modifier string, description string, unit_name string")
    lines = [(0, None, 1.0, None, None, "x", None), (1, 1, None, None, None, "x", None), (2, 1, 2.0, None, None, "x", None), (3, 1, 2.0, None, "large", "x", None), (4, 1, 1.0, "cup", None, "x", None), (5, 2, 1.0, None, None, "x", None), (6, 1, 1.0, "cup", None, "x", 12.0)]
    asked = spark.createDataFrame(lines, "id long, food_id long, quantity double, unit string, size string, name string, bracketed double")
    found = {r["id"]: (r["grams"], r["status"], r["path"]) for r in po.resolved(asked, po.classified(rows), ["id"]).collect()}
    assert found == {
        0: (None, "missing_food", "none"), 1: (None, "no_quantity", "none"), 2: (80.0, "ok_count_portion", "size_ladder"), 3: (60.0, "ok_count_portion", "count"),
        4: (None, "no_portion", "none"), 5: (None, "no_portion", "none"), 6: (12.0, "ok_embedded_mass", "bracketed"),
    }
