"""Convex hulls of nutrient shares as a mergeable aggregate, and what is measured against them.

Mixes of foods in any amounts have energy shares inside the convex hull of the foods' shares, so the hull of
the points is the cone that sampling mixes only approaches.  Shares are held as whole numbers of
``1 / GRID``, so turns are exact and the hull of partial hulls is the hull of all points: every task first
reduces each group's points that it holds to their hull, and only those vertices meet.  A group that holds a
third of all rows thus costs some tens of rows a task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRID = 10**8
#: Points that a task holds before it reduces its groups.
HELD_POINTS = 200_000
#: Points of a group in a task that are passed on as they are.
FEW_POINTS = 16
#: Vertices times points of the hulls worked on together.
CELLS = 500_000
#: Distance, as a share, up to which a point counts as inside.
TOLERANCE = 1e-4
# Calories of a gram of protein, fat and carbohydrate; points an axis of a box is sampled by.
CALORIES = (4.0, 9.0, 4.0)
BOX_POINTS = 5


def share_points(protein: Column, fat: Column, carb: Column) -> tuple[Column, Column]:
    """Protein and carbohydrate share of the energy in units of the grid; null without energy."""
    p, f, c = (x.cast("double") * k for x, k in zip((protein, fat, carb), CALORIES))
    total = p + f + c
    at = lambda part: F.when(total > 0, F.round(part / total * GRID)).cast("long")
    return at(p), at(c)


def convex_hull(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Vertices counter-clockwise from the least point; two ends of collinear points, one of equal ones."""
    points = sorted(set(points))
    if len(points) < 3:
        return points
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    chains = []
    for way in (points, points[::-1]):
        chain: list[tuple[int, int]] = []
        for p in way:
            while len(chain) > 1 and turn(chain[-2], chain[-1], p) <= 0:
                chain.pop()
            chain.append(p)
        chains.append(chain[:-1])
    return chains[0] + chains[1]


def _reduced(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The points of batches, those of groups with more than ``FEW_POINTS`` reduced to their hull: less is not worth it."""
    table = pa.Table.from_batches(held)
    grp, x, y = (table.column(c).to_numpy() for c in ("grp", "x", "y"))
    _, at, n = np.unique(grp, return_inverse=True, return_counts=True)
    many = n[at] > FEW_POINTS
    yield from table.filter(pa.array(~many)).to_batches()
    groups: dict[int, list] = defaultdict(list)
    for g, px, py in zip(grp[many].tolist(), x[many].tolist(), y[many].tolist()):
        groups[g].append((px, py))
    rows = np.array([(g, *v) for g, p in groups.items() for v in convex_hull(p)], np.int64).reshape(-1, 3)
    yield pa.RecordBatch.from_arrays([pa.array(rows[:, k]) for k in range(3)], names=["grp", "x", "y"])


def hulls(points: DataFrame, group: str) -> DataFrame:
    """(group, xs, ys): the hull of each group's points; ``points`` has the group (a whole number), x and y."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= HELD_POINTS:
                yield from _reduced(held)
                held, n = [], 0
        if held:
            yield from _reduced(held)

    def merged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [convex_hull(list(zip(x.tolist(), y.tolist()))) for x, y in zip(frame["xs"], frame["ys"])]
            yield pd.DataFrame({"grp": frame["grp"], "xs": [[v[0] for v in h] for h in found], "ys": [[v[1] for v in h] for h in found]})

    named = points.select(F.col(group).cast("long").alias("grp"), "x", "y").where("grp is not null and x is not null and y is not null").distinct()
    met = named.mapInArrow(partial, "grp long, x long, y long")
    gathered = met.groupBy("grp").agg(F.collect_list(F.struct("x", "y")).alias("v"))
    return gathered.select("grp", F.col("v.x").alias("xs"), F.col("v.y").alias("ys")).mapInPandas(merged, "grp long, xs array<long>, ys array<long>").withColumnRenamed("grp", group)


def distances(xs: np.ndarray, ys: np.ndarray, px: np.ndarray, py: np.ndarray) -> np.ndarray:
    """Distances as shares, 0 inside and on the edge: of the points (row, point) from the hull of their row.

    ``xs`` and ``ys`` are (row, vertex); shorter hulls repeat their last vertex.
    """
    ax, ay = xs[:, None, :], ys[:, None, :]
    bx, by = np.roll(xs, -1, axis=1)[:, None, :], np.roll(ys, -1, axis=1)[:, None, :]
    dx, dy = bx - ax, by - ay
    rx, ry = px[:, :, None] - ax, py[:, :, None] - ay
    squared = (dx * dx + dy * dy).astype(float)
    t = np.clip((rx * dx + ry * dy) / np.where(squared > 0, squared, 1), 0, 1)
    apart = np.hypot(rx - t * dx, ry - t * dy).min(axis=2) / GRID
    turning = (dx * ry - dy * rx >= 0).all(axis=2)
    flat = ((dx * np.roll(dy, -1, axis=2) - dy * np.roll(dx, -1, axis=2)) <= 0).all(axis=2)  # points and segments
    return np.where(turning & ~flat, 0.0, apart)


def _within_a_step(xs: np.ndarray, ys: np.ndarray):
    """Whether one point a row is at most one step of the grid from the hull of its row, as ``distances`` measures it,
    as a function of the points.  What depends on the hulls alone is made once, and lengths only of points close by."""
    dx, dy = np.roll(xs, -1, axis=1) - xs, np.roll(ys, -1, axis=1) - ys
    squared = (dx * dx + dy * dy).astype(float)
    divisor = np.where(squared > 0, squared, 1)
    solid = ~((dx * np.roll(dy, -1, axis=1) - dy * np.roll(dx, -1, axis=1)) <= 0).all(axis=1)

    def inside(px: np.ndarray, py: np.ndarray) -> np.ndarray:
        rx, ry = px[:, None] - xs, py[:, None] - ys
        found = solid & (dx * ry - dy * rx >= 0).all(axis=1)
        out = np.flatnonzero(~found)
        rx, ry, ox, oy = rx[out], ry[out], dx[out], dy[out]
        t = np.clip((rx * ox + ry * oy) / divisor[out], 0, 1)
        ex, ey = rx - t * ox, ry - t * oy
        close = np.flatnonzero(((ex * ex + ey * ey) < 4).any(axis=1))
        found[out[close]] = np.hypot(ex[close], ey[close]).min(axis=1) / GRID <= 1 / GRID
        return found

    return inside


def _padded(frame: pd.DataFrame, points: int) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Rows of about equal hulls with their vertices as matrices, small enough to work on together."""
    sizes = frame["xs"].map(len).to_numpy()
    order, at = np.argsort(sizes, kind="stable"), 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * sizes[order[end]] * points <= CELLS:
            end += 1
        rows = frame.iloc[order[at:end]]
        width = sizes[order[end - 1]]
        pad = lambda c: np.array([[*v, *[v[-1]] * (width - len(v))] for v in rows[c]], np.int64)
        yield rows, pad("xs"), pad("ys")
        at = end


def box_points(low: tuple[float, float, float], high: tuple[float, float, float], n: int = BOX_POINTS) -> list[tuple[int, int]]:
    """Grid points of a box of protein, carbohydrate and fat shares that sum to one; without any, its corners
    with a fat share of 0 or more."""
    axis = lambda k: [low[k] + (high[k] - low[k]) * i / (n - 1) for i in range(n)]
    made = [(p, c) for p in axis(0) for c in axis(1) if low[2] - 1e-9 <= 1 - p - c <= high[2] + 1e-9]
    made = made or [(p, c) for p in (low[0], high[0]) for c in (low[1], high[1]) if p + c <= 1]
    return [(round(p * GRID), round(c * GRID)) for p, c in made]


def against_box(made: DataFrame, group: str, low: tuple[float, float, float], high: tuple[float, float, float]) -> DataFrame:
    """Per hull its vertices, the distance of the box, the share of its points inside, and the outside score:
    the greatest gap of an axis plus that distance."""
    at = box_points(low, high)
    px, py = np.array([p for p, _ in at], np.int64), np.array([c for _, c in at], np.int64)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for rows, xs, ys in _padded(frame, len(px)):
                far = distances(xs, ys, np.tile(px, (len(rows), 1)), np.tile(py, (len(rows), 1)))
                axes = (xs / GRID, ys / GRID, (GRID - xs - ys) / GRID)
                gap = np.max([np.maximum(np.maximum(a.min(axis=1) - h, l - a.max(axis=1)), 0) for a, l, h in zip(axes, low, high)], axis=0)
                least = far.min(axis=1)
                yield pd.DataFrame({
                    group: rows[group].to_numpy(), "n_vertices": rows["xs"].map(len).to_numpy(), "distance": np.round(least, 6),
                    "share_inside": (far <= TOLERANCE).mean(axis=1), "outside_score": np.round(gap + least, 6),
                })

    return made.select(group, "xs", "ys").mapInPandas(run, f"{group} long, n_vertices long, distance double, share_inside double, outside_score double")


def stretch_level(share: Column, outside: Column) -> Column:
    """in_hull, edge or outside_hull, by the share of recipes that meet the box and their median outside score."""
    # The cuts of the levels.
    return F.when((share >= 0.65) & (outside < 0.025), "in_hull").when((share >= 0.35) | (outside < 0.06), "edge").otherwise("outside_hull")


# Fixed values of targets: the range of the way towards a vertex, bisections, the farthest vertices drawn from.
WAY, BISECTIONS, NEAREST = (0.18, 0.38), 32, 3
MIN_VERTEX_DISTANCE = 0.025


def boundary_ways(xs: np.ndarray, ys: np.ndarray, at: np.ndarray, towards: np.ndarray) -> np.ndarray:
    """How far the rays from ``at`` (row, 2) along ``towards`` (row, 2; grid units) stay inside the hull of
    their row, by bisection of all rays together between 0 and twice the hull's width."""
    span = 2.0 * np.maximum(np.maximum(np.ptp(xs, axis=1), np.ptp(ys, axis=1)), 1)
    length = np.hypot(towards[:, 0], towards[:, 1])
    low, high = np.zeros(len(towards)), np.where(length > 0, span / np.maximum(length, 1e-300), 0.0)
    close = _within_a_step(xs, ys)
    for _ in range(BISECTIONS):
        middle = (low + high) / 2
        inside = close(*(np.rint(at[:, k] + middle * towards[:, k]).astype(np.int64) for k in (0, 1)))
        low, high = np.where(inside, middle, low), np.where(inside, high, middle)
    return low


def draws(seed: int, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per group a number from 0 to 1, a way and an angle, by the seed and the group alone."""
    x = groups.astype(np.int64).view(np.uint64)[None, :] + np.arange(1, 4, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)
    return u[0], WAY[0] + u[1] * (WAY[1] - WAY[0]), 2 * np.pi * u[2]


def targets(made: DataFrame, baselines: DataFrame, group: str, seed: int = 0) -> DataFrame:
    """(group, kind, x, y): seeded targets of each group, in grid units.

    ``close`` lies a drawn way (0.18 to 0.38) from the baseline towards one of the three farthest vertices;
    ``edge`` where a ray in a drawn direction leaves the hull; ``outside`` a tenth beyond.  Draws depend on
    the seed and the group alone.  ``baselines`` has the group, bx and by.  Groups whose vertices are all
    nearer to the baseline than 0.025 (as shares, in L1) get no ``close`` target.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for rows, xs, ys in _padded(frame, 1):
                groups = rows[group].to_numpy()
                at = rows[["bx", "by"]].to_numpy(float)
                pick, way, angle = draws(seed, groups)
                rays = np.stack([np.cos(angle), np.sin(angle)], axis=1) * GRID
                edge = boundary_ways(xs, ys, at, rays)
                gap = (np.abs(xs - at[:, :1]) + np.abs(ys - at[:, 1:]) + np.abs(xs + ys - at.sum(axis=1, keepdims=True))) / GRID
                first = np.concatenate([np.ones((len(rows), 1), bool), (np.diff(xs, axis=1) != 0) | (np.diff(ys, axis=1) != 0)], axis=1)
                open_ = first & (gap >= MIN_VERTEX_DISTANCE)
                order = np.lexsort((ys, xs, -gap, ~open_), axis=1)
                far = np.minimum(open_.sum(axis=1), NEAREST)
                k = np.take_along_axis(order, np.minimum(pick * far, np.maximum(far - 1, 0)).astype(int)[:, None], axis=1)
                vertex = np.concatenate([np.take_along_axis(v, k, axis=1) for v in (xs, ys)], axis=1)
                kinds = [("close", at + way[:, None] * (vertex - at), far > 0), ("edge", at + edge[:, None] * rays, slice(None)), ("outside", at + 1.1 * edge[:, None] * rays, slice(None))]
                for kind, spot, kept in kinds:
                    spot = np.rint(spot[kept]).astype(np.int64)
                    yield pd.DataFrame({group: groups[kept], "kind": kind, "x": spot[:, 0], "y": spot[:, 1]})

    return made.join(baselines, group).select(group, "xs", "ys", "bx", "by").mapInPandas(run, f"{group} long, kind string, x long, y long")
