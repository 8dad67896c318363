"""Loss fields on a lattice of protein and carbohydrate shares, with minima over boxes by block minima.

The loss of a lattice point is the weighted mean L1 distance to the recipes' shares.  With the fat share as
what is left, it is a sum of three terms that depend on the protein step, the carbohydrate step and the sum
of both, so it comes from three histograms and no pair of a point and a recipe is formed.

``block_minima`` holds the least loss of every square block of the lattice, the blocks of a level twice as
wide as those of the level below.  A box asks from the widest block down: blocks outside it go, blocks inside
answer by their minimum, and of those that it cuts only blocks that may still beat the best answer so far are
split.  So thousands of boxes never rescan the lattice.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.lineage import checkpointed


def lattice_loss(points: DataFrame, steps: int) -> DataFrame:
    """(i, j, loss) of the lattice points with i + j at most ``steps``; ``points`` has whole numbers p and c,
    the shares in units of 1 / steps, and a weight.  The loss is rounded to eight places."""
    known = points.select("p", "c", "weight").where("p is not null and c is not null and weight > 0")
    # at most (steps + 1)**2 rows from here on
    bins = checkpointed(known.groupBy("p", "c").agg(F.sum("weight").alias("w")))
    total = bins.agg(F.sum("w").alias("total"))
    line = points.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("at"))

    def term(coordinate, name: str) -> DataFrame:
        """Per step the weighted sum of distances along one axis, from its histogram."""
        axis = bins.groupBy(coordinate.alias("value")).agg(F.sum("w").alias("w"))
        return line.crossJoin(F.broadcast(axis)).groupBy("at").agg(F.sum(F.col("w") * F.abs(F.col("at") - F.col("value"))).alias(name))

    a, b, s = term(F.col("p"), "a"), term(F.col("c"), "b"), term(F.col("p") + F.col("c"), "s")
    cells = a.withColumnRenamed("at", "i").crossJoin(F.broadcast(b.withColumnRenamed("at", "j"))).where(F.col("i") + F.col("j") <= steps)
    summed = cells.join(s.withColumnRenamed("at", "k"), F.col("i") + F.col("j") == F.col("k")).crossJoin(F.broadcast(total))
    return summed.select("i", "j", F.round((F.col("a") + F.col("b") + F.col("s")) / (F.col("total") * steps), 8).alias("loss"))


def block_minima(lattice: DataFrame, steps: int) -> DataFrame:
    """(level, bi, bj, least): ``least`` is a struct of the loss and the point (loss, i, j), the first by loss, i
    and j.  Level 0 holds the points themselves."""
    out = level = checkpointed(lattice.select(F.lit(0).alias("level"), F.col("i").alias("bi"), F.col("j").alias("bj"), F.struct("loss", "i", "j").alias("least")))
    for k in range(1, max(1, math.ceil(math.log2(steps + 1))) + 1):
        level = level.groupBy(F.floor(F.col("bi") / 2).cast("int").alias("bi"), F.floor(F.col("bj") / 2).cast("int").alias("bj")).agg(F.min("least").alias("least")).select(F.lit(k).alias("level"), "bi", "bj", "least")
        level = checkpointed(level)
        out = out.unionByName(level)
    return checkpointed(out)


def box_minima(boxes: DataFrame, minima: DataFrame, steps: int) -> DataFrame:
    """(box_id, loss, i, j): the least loss of lattice points inside each box; boxes without any give no row.

    ``boxes`` has box_id and whole bounds p_low, p_high, c_low, c_high, f_low, f_high in units of 1 / steps.
    """
    top = max(1, math.ceil(math.log2(steps + 1)))
    front = boxes.withColumn("bi", F.lit(0)).withColumn("bj", F.lit(0))
    answers = None
    for k in range(top, -1, -1):
        width = 1 << k
        met = front.join(minima.where(F.col("level") == k).select("bi", "bj", "least"), ["bi", "bj"])
        i0, j0 = F.col("bi") * width, F.col("bj") * width
        i1, j1 = i0 + width - 1, j0 + width - 1
        # of the points i + j the fat share is steps - i - j
        apart = (i1 < F.col("p_low")) | (i0 > F.col("p_high")) | (j1 < F.col("c_low")) | (j0 > F.col("c_high")) | (steps - i0 - j0 < F.col("f_low")) | (steps - i1 - j1 > F.col("f_high"))
        inside = (i0 >= F.col("p_low")) & (i1 <= F.col("p_high")) & (j0 >= F.col("c_low")) & (j1 <= F.col("c_high")) & (steps - i1 - j1 >= F.col("f_low")) & (steps - i0 - j0 <= F.col("f_high"))
        # a block whose least point lies in the box answers too
        at_i, at_j = F.col("least.i"), F.col("least.j")
        holds = at_i.between(F.col("p_low"), F.col("p_high")) & at_j.between(F.col("c_low"), F.col("c_high")) & (steps - at_i - at_j).between(F.col("f_low"), F.col("f_high"))
        met = checkpointed(met.where(~apart).withColumn("answers", inside | holds))
        found = met.where("answers").groupBy("box_id").agg(F.min("least").alias("best"))
        answers = found if answers is None else answers.unionByName(found).groupBy("box_id").agg(F.min("best").alias("best"))
        answers = checkpointed(answers)
        if k == 0:
            break
        open_ = met.where("not answers").join(answers, "box_id", "left").where("best is null or least < best")
        half = F.explode(F.array(*[F.struct((2 * F.col("bi") + a).alias("bi"), (2 * F.col("bj") + b).alias("bj")) for a in (0, 1) for b in (0, 1)]))
        front = open_.select(*boxes.columns, half.alias("b")).select(*boxes.columns, "b.bi", "b.bj")
    return answers.select("box_id", "best.loss", "best.i", "best.j")


def basin(lattice: DataFrame, share: float = 0.25) -> DataFrame:
    """(i, j, loss, threshold): points whose loss is at most the interpolated quantile; the lattice's size is
    a parameter, not that of the input."""
    cut = lattice.agg(F.round(F.percentile("loss", share), 8).alias("threshold"))
    return lattice.crossJoin(F.broadcast(cut)).where("loss <= threshold").select("i", "j", "loss", "threshold")


def corridor(boxes: DataFrame, low: DataFrame, minima_steps: int) -> DataFrame:
    """(box_id, distance, i, j): the point of the basin nearest to each box in L1, in units of the lattice; of
    equal ones the first by i and j.

    Every box meets every point of the basin, whose number is bounded by the lattice, a parameter.  A meeting is one
    whole number that holds distance, i and j in this order, so the least of a box is kept in a hash map and no
    meeting is sorted or shuffled.
    """
    met = boxes.crossJoin(F.broadcast(low.select("i", "j")))  # at most (``minima_steps`` + 1)**2 rows, a parameter
    gap = lambda x, a, b: F.greatest(F.col(a) - x, x - F.col(b), F.lit(0))
    i, j, side = F.col("i"), F.col("j"), minima_steps + 1
    distance = gap(i, "p_low", "p_high") + gap(j, "c_low", "c_high") + gap(minima_steps - i - j, "f_low", "f_high")
    best = met.select("box_id", ((distance.cast("long") * side + i) * side + j).alias("b")).groupBy("box_id").agg(F.min("b").alias("b"))
    part = lambda c: c.cast("int")
    return best.select("box_id", part(F.expr(f"b div {side * side}")).alias("distance"), part(F.expr(f"b div {side}") % side).alias("i"), part(F.col("b") % side).alias("j"))
