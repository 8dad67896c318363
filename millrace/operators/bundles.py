"""Bundles of edits and subsets of ontology nodes: enumeration that is whole, split over tasks and pruned by
bounds that lose nothing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.lineage import checkpointed, stored


def bundles(candidates: DataFrame, max_size: int, cap: int | None = None) -> DataFrame:
    """(problem, ids, size, score, rank): sets of up to ``max_size`` candidates of different slots without a
    conflict; with ``cap`` the best of each problem by score, then by size and ids.

    ``candidates`` has problem, slot, id, line (null: none), food, label and score.  Two candidates conflict if
    they share the line, the food or the label (ASCII case aside).  Bundles grow slot by slot, so each set comes
    up once.  With ``cap``, a bundle grows only if it can still reach the ``cap``-th best score that is known:
    its own score plus the best scores of the slots left, for as many as may join.  Without, all are listed.

    Problems of equal candidates are one class: bundles are found once a class, under its least problem, and every
    member gets them at the end.
    """
    every = checkpointed(candidates.select("problem", "slot", "id", "line", "food", F.lower("label").alias("label"), "score"))
    same = F.array_sort(F.collect_list(F.struct("slot", "id", "line", "food", "label", "score")))
    alike = checkpointed(every.where("problem is not null").groupBy("problem").agg(F.sha2(F.to_json(same, {"ignoreNullFields": "false"}), 256).alias("same")))
    members = checkpointed(alike.join(alike.groupBy("same").agg(F.min("problem").alias("class")), "same").select("problem", "class"))
    c = checkpointed(every.join(members.where(F.col("problem") == F.col("class")).select("problem"), "problem", "left_semi"))
    per = Window.partitionBy("problem")
    slots = c.groupBy("problem", "slot").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("best"))
    later = slots.alias("a").join(slots.alias("b"), F.expr("a.problem = b.problem and b.slot > a.slot"), "left")
    later = checkpointed(later.groupBy("a.problem", "a.slot").agg(F.sort_array(F.collect_list("b.best"), asc=False).alias("later")))
    one = lambda x: F.array(F.col(x))
    lines = F.when(F.col("line").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.col("line").cast("string")))
    level = checkpointed(c.select("problem", F.col("slot").alias("last"), one("id").alias("ids"), lines.alias("lines"), one("food").alias("foods"), one("label").alias("labels"), "score"))
    out = level.select("problem", "ids", F.lit(1).alias("size"), "score")
    for size in range(2, max_size + 1):
        grow = level
        if cap is not None:
            order = per.orderBy(F.desc("score"), "size", "ids")
            known = checkpointed(out.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= cap))
            out = known.drop("nth")
            bound = known.where(F.col("nth") == cap).select("problem", F.col("score").alias("bound"))
            left = F.aggregate(F.slice("later", 1, max_size - size + 1), F.lit(0.0), lambda s, x: s + x)
            grow = level.join(later.withColumnRenamed("slot", "last"), ["problem", "last"]).join(bound, "problem", "left").where(F.col("bound").isNull() | (F.col("score") + left >= F.col("bound") - 1e-9)).select(*level.columns)
        more = c.select("problem", F.col("slot").alias("slot2"), F.col("id").alias("id2"), F.col("line").cast("string").alias("line2"), F.col("food").alias("food2"), F.col("label").alias("label2"), F.col("score").alias("score2"))
        free = (F.col("slot2") > F.col("last")) & (F.col("line2").isNull() | ~F.array_contains("lines", F.col("line2"))) & ~F.coalesce(F.array_contains("foods", F.col("food2")), F.lit(False)) & ~F.coalesce(F.array_contains("labels", F.col("label2")), F.lit(False))
        met = grow.join(more, "problem").where(free)
        longer = F.when(F.col("line2").isNull(), F.col("lines")).otherwise(F.concat("lines", F.array("line2")))
        level = checkpointed(met.select("problem", F.col("slot2").alias("last"), F.concat("ids", F.array("id2")).alias("ids"), longer.alias("lines"), F.concat("foods", F.array("food2")).alias("foods"), F.concat("labels", F.array("label2")).alias("labels"), (F.col("score") + F.col("score2")).alias("score")))
        out = out.unionByName(level.select("problem", "ids", F.lit(size).alias("size"), "score"))
    ranked = out.withColumn("rank", F.row_number().over(per.orderBy(F.desc("score"), "size", "ids")))
    kept = ranked if cap is None else ranked.where(F.col("rank") <= cap)
    return members.join(kept.withColumnRenamed("problem", "class"), "class").select("problem", "ids", "size", "score", "rank")


# Nodes of an answer at least; nodes up to which all subsets are tried.
LEAST_NODES, EXACT_NODES = 4, 18
#: Subsets that one row stands for.
MASKS_A_ROW = 1 << 12


def _scores(masks: np.ndarray, a: np.ndarray, b: np.ndarray, weight: np.ndarray, same: float) -> np.ndarray:
    """Mean Jaccard over the pairs (a, b) of recipes within each mask; pairs of equal recipes count 1."""
    total = np.full(len(masks), same)
    for at in range(0, len(a), 512):
        x, y, w = a[at : at + 512, None], b[at : at + 512, None], weight[at : at + 512, None]
        either = np.bitwise_count((x | y) & masks).astype(float)
        total += (w * np.where(either > 0, np.bitwise_count(x & y & masks) / np.maximum(either, 1), 1)).sum(axis=0)
    pairs = same + weight.sum()
    return np.round(total / pairs, 9) if pairs else np.ones(len(masks))


def _pairs(recipes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    i, j = np.triu_indices(len(recipes), 1)
    return recipes[i], recipes[j], (counts[i] * counts[j]).astype(float), float((counts * (counts - 1) // 2).sum())


@lru_cache(maxsize=256)
def _antichains(n: int, above: tuple[int, ...], low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The masks from ``low`` to ``high`` - 1 without a node and its ancestor, and their numbers of nodes; problems whose
    nodes lie alike share them."""
    masks = np.arange(max(low, 1), high, dtype=np.int64)
    for i, up in enumerate(above):
        if up:
            masks = masks[((masks >> (n - 1 - i)) & 1 == 0) | (masks & up == 0)]
    return masks, np.bitwise_count(masks).astype(np.int64)


def best_of_all(n: int, above: np.ndarray, recipes: np.ndarray, counts: np.ndarray, low: int, high: int) -> tuple[float, int]:
    """The best (score, mask) of the masks from ``low`` to ``high`` - 1.  Node i is bit n - 1 - i, ``above[i]`` the
    mask of its ancestors.  Antichains only; fewer than LEAST_NODES score -1; of equal scores more nodes
    win, then the nodes that come first."""
    masks, size = _antichains(n, tuple(int(x) for x in above), low, high)
    if not len(masks):
        return -2.0, 0
    enough = size >= LEAST_NODES
    if enough.any():
        masks, size = masks[enough], size[enough]
        score = _scores(masks, *_pairs(recipes, counts))
    else:
        score = np.full(len(masks), -1.0)
    best = score == score.max()
    masks, size = masks[best], size[best]
    return float(score.max()), int(masks[size == size.max()].max())


def climb(n: int, above: list[int], recipes: list[int], counts: list[int], hits: list[int]) -> tuple[float, int]:
    """Hill climb for more nodes than can be tried in all: from the nodes without a descendant (or, if those
    are too few, the LEAST_NODES of most hits) every node is added or taken away in turn, and what is better
    stays, until a whole turn changes nothing."""
    bit = lambda i: 1 << (n - 1 - i)
    pairs = [(a, b, x * y) for (a, x), (b, y) in combinations(list(zip(recipes, counts)), 2)]
    same = sum(x * (x - 1) // 2 for x in counts)
    whole = same + sum(w for *_, w in pairs)

    def score(mask: int) -> float:
        if mask.bit_count() < LEAST_NODES:
            return -1.0
        if not whole:
            return 1.0
        total = float(same)
        for a, b, w in pairs:
            either = ((a | b) & mask).bit_count()
            total += w * ((a & b & mask).bit_count() / either if either else 1.0)
        return round(total / whole, 9)

    inner = 0
    for i in range(n):
        inner |= above[i]
    now = sum(bit(i) for i in range(n) if not inner & bit(i))
    if now.bit_count() < LEAST_NODES:
        now = sum(bit(i) for i in sorted(range(n), key=lambda i: (-hits[i], i))[:LEAST_NODES])
    rank = lambda m: (score(m), m.bit_count(), m)
    best, improved = rank(now), True
    while improved:
        improved = False
        for i in range(n):
            trial = best[2] ^ bit(i)
            if trial and not any(trial & bit(k) and trial & above[k] for k in range(n)) and rank(trial) > best:
                best, improved = rank(trial), True
    return best[0], best[2]


def best_subsets(presence: DataFrame, nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(problem, nodes, score): the antichain of each problem's nodes under which its recipes are most alike.

    ``presence`` has distinct (problem, recipe_id, node), recipes without a node in ``nodes`` included by a null
    node; ``nodes`` the candidates (problem, node); ``paths`` (node, ancestor, depth).
    """
    held = presence.groupBy("problem", "recipe_id").agg(F.array_sort(F.collect_set("node")).alias("held"))
    return best_subsets_of(held.groupBy("problem", "held").agg(F.count(F.lit(1)).alias("n")), nodes, paths)


def best_subsets_of(sets: DataFrame, nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """``best_subsets`` of recipes given as (problem, held, n): how many recipes of the problem hold just these nodes.

    Up to EXACT_NODES nodes all subsets are tried, MASKS_A_ROW of them a row, so a problem is split over tasks; above,
    ``climb``.  Recipes that hold the same candidates are one row with a count.  Ancestors are asked of the ontology
    once a node, and all of a problem is made from its row of candidates by one shuffle.
    """
    ups = paths.where("depth > 0").groupBy("node").agg(F.collect_set("ancestor").alias("ups"))
    named = nodes.select("problem", "node").distinct().join(ups, "node", "left").groupBy("problem").agg(F.array_sort(F.collect_list(F.struct("node", "ups"))).alias("c"))
    # read twice, and apart from the joins so that a task holds fewer sorts at a time
    named = named.select("problem", F.col("c.node").alias("nodes"), F.transform("c.ups", lambda u: F.coalesce(u, F.array().cast("array<string>"))).alias("ups"))
    named = stored(named, "named").hint("merge")  # compressed, it looks small enough for a broadcast
    places = lambda names: F.transform(F.array_intersect("nodes", names), lambda x: F.array_position("nodes", x).cast("int") - 1)
    met = sets.join(named, "problem").groupBy("problem", places(F.col("held")).alias("held")).agg(F.sum("n").alias("n"))
    recipes = met.groupBy("problem").agg(F.collect_list(F.struct("held", "n")).alias("r"))
    whole = named.join(recipes, "problem").select("problem", "nodes", F.transform("ups", places).alias("ups"), F.col("r.held").alias("held"), F.col("r.n").alias("counts"))
    n = F.size("nodes")
    blocks = F.when(n <= EXACT_NODES, F.sequence(F.lit(0), F.floor((F.pow(F.lit(2.0), F.least(n, F.lit(EXACT_NODES))) - 1) / MASKS_A_ROW).cast("int"))).otherwise(F.array(F.lit(-1)))
    rows = whole.withColumn("block", F.explode(blocks)).repartition(F.col("problem"), F.col("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen, scores = [], []
            for names, ups, held, counts, block in zip(*(batch.column(c).to_pylist() for c in ("nodes", "ups", "held", "counts", "block"))):
                n = len(names)
                bits = lambda at: sum(1 << (n - 1 - i) for i in at)  # noqa: E731, B023
                up, masks = [bits(x) for x in ups], [bits(x) for x in held]
                if block < 0:
                    hits = [sum(c for x, c in zip(masks, counts) if x >> (n - 1 - i) & 1) for i in range(n)]
                    score, mask = climb(n, up, masks, counts, hits)
                else:
                    low, high = block * MASKS_A_ROW, min((block + 1) * MASKS_A_ROW, 1 << n)
                    score, mask = best_of_all(n, up, np.array(masks, np.int64), np.array(counts, np.int64), low, high)
                chosen.append([x for i, x in enumerate(names) if mask >> (n - 1 - i) & 1])
                scores.append(score)
            size = pa.array([len(c) for c in chosen], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("problem"), pa.array(chosen, pa.list_(pa.string())), size, pa.array(scores, pa.float64())], names=["problem", "nodes", "size", "score"])

    kind = sets.schema["problem"].dataType.simpleString()
    found = rows.mapInArrow(run, f"problem {kind}, nodes array<string>, size long, score double")
    best = found.groupBy("problem").agg(F.min_by(F.struct("nodes", "score"), F.struct(-F.col("score"), -F.col("size"), F.col("nodes"))).alias("b"))
    return best.select("problem", "b.nodes", "b.score")
