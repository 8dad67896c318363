"""Similarity join of sets by prefix, size and position filters.

Items are ordered rarest first.  Two sets with a Jaccard similarity of t or more share an item within
their first ``n - ceil(t n) + 1`` items, so only those prefixes meet in a join by item.  A pair is kept at
its first common item alone, and before its overlap is counted it has to pass the size filter (neither
set is smaller than t times the other) and the position filter (the items left behind the common one
suffice).  Nothing is sampled or cut: every pair at or above its threshold comes out once.

Each row has a threshold of its own, a lower bound over all pairs it may take part in; of a pair the
greater one holds.  At a threshold of 0 the prefix is the whole set and every pair with a common item
comes out.  Equal sets belong in one row, as the caller can tell members from classes (``classes``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.lineage import stored

EPS = 1e-9


def classes(sets: DataFrame, key: str, items: str, also: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Distinct sets as (class, items, *also), and the members (key, class); the class is the least key."""
    sorted_ = sets.select(key, *also, F.array_sort(items).alias("items")).where(F.size("items") > 0)
    made = sorted_.groupBy("items", *also).agg(F.min(key).alias("class"))
    members = sorted_.join(made, ["items", *also]).select(key, *also, "class")
    return made, members


def item_counts(*sides: DataFrame) -> DataFrame:
    """(item, item_count) over the ``items`` of all sides."""
    items = [s.select(F.explode("items").alias("item")) for s in sides]
    every = items[0]
    for more in items[1:]:
        every = every.unionByName(more)
    return every.groupBy("item").agg(F.count(F.lit(1)).alias("item_count"))


def rarest_first(sets: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """``sets`` (unique ``keys``, items, floor) with their items ordered by count, then by item."""
    apart = sets.select(*keys, "floor", F.explode("items").alias("item")).join(counts, "item")
    ordered = F.array_sort(F.collect_list(F.struct("item_count", "item")))
    return apart.groupBy(*keys, "floor").agg(F.transform(ordered, lambda x: x["item"]).alias("items"))


def rarest_first_sets(rows: DataFrame, key: str, item: str, labels: DataFrame | None = None) -> DataFrame:
    """(key, items) of (key, item): the distinct items of each key, ordered by their count, then by item.  The items
    are put in order as the sets are made, so the sets are not taken apart again.  With ``labels``, which has item and
    label, the distinct labels of a key's items come along as ``labels``, from the same two shuffles."""
    distinct = rows.where(F.col(item).isNotNull()).select(key, F.col(item).alias("item"))
    counts = stored(distinct.groupBy("item").agg(F.count(F.lit(1)).alias("item_count")), "counts")
    sets = [F.transform(F.array_sort(F.collect_set(F.struct("item_count", "item"))), lambda x: x["item"]).alias("items")]
    if labels is not None:
        counts = counts.join(labels, "item", "left")
        sets.append(F.collect_set("label").alias("labels"))
    # rows are narrower than the partial sets that would be shuffled otherwise, as lines of a key seldom lie together
    return distinct.join(counts, "item").repartition(key).groupBy(key).agg(*sets)


def classes_of(sets: DataFrame, key: str, *more: Column) -> tuple[DataFrame, DataFrame]:
    """Like ``classes`` for a stored table of ``rarest_first_sets``: (class, items, copies), and the members (key, class).
    Only sets that occur more than once are looked up again; the others are their own class.  ``more`` are further
    aggregates of a class."""
    made, copied = copies_of(sets, key, *more)
    alone = made.where("copies = 1").select(F.col("class").alias(key), "class")
    return made, alone.unionByName(copied)


def copies_of(sets: DataFrame, key: str, *more: Column) -> tuple[DataFrame, DataFrame]:
    """``classes_of`` with the members (key, class) of those classes alone that have more than one."""
    made = stored(sets.groupBy("items").agg(F.min(key).alias("class"), F.count(F.lit(1)).alias("copies"), *more), "classes")
    several = stored(made.where("copies > 1").select("items", "class"), "several")
    return made, stored(sets.join(several, "items").select(key, "class"), "copies")


def prefix_length(n: Column, floor: Column) -> Column:
    """How many of the n rarest items a partner at ``floor`` or above has to share one of."""
    return (n - F.greatest(F.lit(1), F.ceil(floor * n - EPS)) + 1).cast("int")


def _indexed(sets: DataFrame, side: str) -> DataFrame:
    apart = F.posexplode(F.slice("items", F.lit(1), prefix_length(F.size("items"), F.col("floor")))).alias(f"{side}_at", "item")
    return sets.select(*[F.col(c).alias(f"{side}_{c}") for c in sets.columns], apart)


def candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """All meetings of prefixes, before any filter; both sides ordered by ``rarest_first``."""
    met = _indexed(left, "l").join(_indexed(right, "r"), "item")
    return met.withColumn("l_n", F.size("l_items")).withColumn("r_n", F.size("r_items"))


def _passing(met: DataFrame, floor: Column) -> DataFrame:
    t = floor
    needed = F.ceil(t / (1 + t) * (F.col("l_n") + F.col("r_n")) - EPS)
    size = (F.col("l_n") >= t * F.col("r_n") - EPS) & (F.col("r_n") >= t * F.col("l_n") - EPS)
    position = 1 + F.least(F.col("l_n") - F.col("l_at"), F.col("r_n") - F.col("r_at")) - 1 >= needed
    return met.where(size & position)


def filter_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: pairs with any common item, meetings of prefixes, those that pass size and position, pairs found."""
    whole = lambda s: s.withColumn("floor", F.lit(0.0))
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    met = candidates(left, right)
    return (
        n(similar_sets(whole(left), whole(right)), "pairs_sharing")
        .crossJoin(n(met, "prefix_meetings"))
        .crossJoin(n(_passing(met, F.greatest("l_floor", "r_floor")), "after_filters"))
        .crossJoin(n(similar_sets(left, right), "pairs_found"))
    )


def similar_classes(sets: DataFrame) -> DataFrame:
    """(a, b, jaccard), a < b: pairs of classes at or above the greater of their floors.

    ``sets`` has class, items (rarest first) and floor and is stored, so the prefixes are shuffled once for both sides.
    """
    pairs = similar_sets(sets, sets, F.col("l_class") < F.col("r_class"))
    return pairs.select(F.col("l_class").alias("a"), F.col("r_class").alias("b"), "jaccard")


def similar_sets(left: DataFrame, right: DataFrame, only: Column | None = None, pair_floor: Column | None = None) -> DataFrame:
    """Pairs of rows at or above their threshold: the keys of both sides as l_..., r_..., overlap, jaccard; with
    ``only`` those it holds for.

    Both sides are ordered by ``rarest_first`` with the same counts.  ``pair_floor`` is a threshold of the pair, made
    of the columns of both sides, and nowhere below those of the rows; above 1 the pair is left out.
    """
    floor = F.greatest("l_floor", "r_floor") if pair_floor is None else pair_floor
    common = F.array_intersect("l_items", "r_items")  # in the order of the left side, which is that of the right
    met = candidates(left, right)
    kept = _passing(met if only is None else met.where(only), floor).withColumn("common", common).where(F.element_at("common", 1) == F.col("item"))
    jaccard = F.size("common") / (F.col("l_n") + F.col("r_n") - F.size("common"))
    scored = kept.withColumn("overlap", F.size("common")).withColumn("jaccard", jaccard)
    keys = [f"{side}_{c}" for side, df in (("l", left), ("r", right)) for c in df.columns if c not in ("items", "floor")]
    return scored.where(F.col("jaccard") >= floor - EPS).select(*keys, "overlap", "jaccard")
