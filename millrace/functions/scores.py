"""Column functions for sets, nutrition fractions, bands and zones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Energy of a gram, and unit sizes in milliliters and grams.
KCAL_PER_GRAM = {"protein": 4.0, "carb": 4.0, "fat": 9.0}
ML_PER_UNIT = {
    "teaspoon": 4.92892159375, "tablespoon": 14.7867647813, "fluid_ounce": 29.5735295625, "cup": 236.5882365, "pint": 473.176473,
    "quart": 946.352946, "gallon": 3785.411784, "milliliter": 1.0, "liter": 1000.0, "cubic_inch": 16.387064,
}
GRAMS_PER_UNIT = {"gram": 1.0, "kilogram": 1000.0, "ounce": 28.349523125, "pound": 453.59237}


def jaccard(a: Column, b: Column, *, empty: float = 0.0) -> Column:
    """Set similarity of two arrays; ``empty`` is the value for two empty ones, one empty gives 0."""
    both, either = F.array_size(F.array_intersect(a, b)), F.array_size(F.array_union(a, b))
    return F.when(either == 0, F.lit(float(empty))).otherwise(both / either)


def f_beta(a: Column, b: Column, beta: float = 0.5) -> Column:
    """Precision-weighted overlap of query tokens ``a`` with food tokens ``b``."""
    both = F.array_size(F.array_intersect(a, b))
    recall = F.coalesce(F.try_divide(both, F.array_size(a)), F.lit(0.0))
    precision = F.coalesce(F.try_divide(both, F.array_size(b)), F.lit(0.0))
    return F.when(both == 0, 0.0).otherwise((1 + beta**2) * precision * recall / (beta**2 * precision + recall))


def containment_bonus(a: Column, b: Column) -> Column:
    """Jaccard of query tokens ``a`` with ``b``, a quarter more if all of ``a`` is in ``b``, at most 1; 0 if one is empty."""
    size = F.array_size(a)
    bonus = F.when((size > 0) & (F.array_size(F.array_intersect(a, b)) == size), 0.25).otherwise(0.0)
    return F.least(jaccard(a, b) + bonus, F.lit(1.0))


def label_match(term: Column, label: Column) -> Column:
    """1 for equal labels, more than 0.92 for a prefix, more than 0.75 for a part, else the share of
    characters that need no edit; 0 if one is empty."""
    t, s = (F.regexp_replace(F.lower(F.trim(x)), r"\s+", " ") for x in (term, label))
    share = F.try_divide(F.length(t), F.length(s))
    return (
        F.when((t == "") | (s == ""), 0.0)
        .when(t == s, 1.0)
        .when(F.startswith(s, t), 0.92 + 0.08 * share)
        .when(F.contains(s, t), 0.75 + 0.2 * share)
        .otherwise(edit_ratio(t, s))
    )


def edit_ratio(a: Column, b: Column) -> Column:
    """1 minus the edit distance over the longer length."""
    return 1 - F.try_divide(F.levenshtein(a, b), F.greatest(F.length(a), F.length(b)))


def weighted_levels(levels: list[tuple[Column, Column]], weights: list[float]) -> Column:
    """Jaccard at several levels of abstraction, weighted; two empty sets count as equal."""
    return sum((w / sum(weights) * jaccard(a, b, empty=1.0) for (a, b), w in zip(levels, weights)), F.lit(0.0))


def box_distance(shares: list[Column], lows: list[float], highs: list[float]) -> Column:
    """L1 distance of shares to a box; 0 inside."""
    parts = [F.greatest(lo - p, F.lit(0.0)) + F.greatest(p - hi, F.lit(0.0)) for p, lo, hi in zip(shares, lows, highs)]
    return sum(parts, F.lit(0.0))


def energy_shares(protein: Column, fat: Column, carb: Column) -> list[Column]:
    """Energy shares of protein, fat and carbohydrate; 0 without energy."""
    total = kcal(protein, fat, carb)
    grams = {"protein": protein, "fat": fat, "carb": carb}
    return [F.when(total <= 0, 0.0).otherwise(F.try_divide(g * KCAL_PER_GRAM[n], total)) for n, g in grams.items()]


def logistic_badness(z: Column, steepness: float = 1.5, middle: float = 2.0) -> Column:
    """0 to 1 by a logistic curve; the exponent is held within 60."""
    t = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), steepness * (z - middle)))
    return 1 / (1 + F.exp(-t))


def unit_size(unit: Column, sizes: dict[str, float]) -> Column:
    """Base units in one ``unit``; null for unknown ones."""
    out = F.lit(None).cast("double")
    for name, size in sizes.items():
        out = F.when(unit == name, size).otherwise(out)
    return out


def convert(amount: Column, source: Column, target: Column) -> Column:
    """``amount`` between units of one kind; null across kinds or for unknown units."""
    volume = unit_size(source, ML_PER_UNIT) / unit_size(target, ML_PER_UNIT)
    mass = unit_size(source, GRAMS_PER_UNIT) / unit_size(target, GRAMS_PER_UNIT)
    return amount * F.coalesce(volume, mass)


def kcal(protein: Column, fat: Column, carb: Column) -> Column:
    """Energy from grams."""
    return protein * KCAL_PER_GRAM["protein"] + fat * KCAL_PER_GRAM["fat"] + carb * KCAL_PER_GRAM["carb"]


def range_fit(shares: list[Column], lows: list[float], highs: list[float], eps: float = 1e-6) -> Column:
    """Length of the vector of log-ratio violations of a box; 0 inside."""
    total = F.lit(0.0)
    for p, lo, hi in zip(shares, lows, highs):
        safe = F.greatest(p, F.lit(eps))
        v = F.greatest(F.lit(0.0), F.log(F.lit(max(lo, eps)) / safe), F.log(safe / F.lit(hi)))
        total = total + v * v
    return F.sqrt(total)


def fit_score(fit: Column, tol: float = 1e-6) -> Column:
    """1 in range, falling to 0."""
    return F.when(fit <= tol, 1.0).otherwise(1.0 / (1.0 + fit))


def iqr_zone(value: Column, q25: Column, mid: Column, q75: Column, whisker: float = 1.5) -> Column:
    """green, yellow or red by quartiles and fences; degenerate quartiles are green."""
    width = q75 - q25
    flat = (width <= 1e-12) | (width / F.greatest(F.abs(mid), F.abs(q25), F.abs(q75), F.lit(1e-9)) <= 1e-6)
    return (
        F.when(value.isNull() | q25.isNull() | flat, "green")
        .when(value.between(q25, q75), "green")
        .when(value.between(q25 - whisker * width, q75 + whisker * width), "yellow")
        .otherwise("red")
    )


def fidelity_band(worst: Column, n_red: Column, feasible: Column, intersects: Column, identity_red: Column, accept: float = 1.0, most: float = 1.5) -> Column:
    """accept, moderate or must_retry."""
    return (
        F.when(~feasible | ~intersects | identity_red | (n_red >= 1) | (worst > most), "must_retry")
        .when(worst <= accept, "accept")
        .otherwise("moderate")
    )


def share_band(share: Column, q1: Column, q3: Column, n: Column, whisker: float = 1.5, min_n: int = 5, eps: float = 0.01) -> Column:
    """good, warn, bad or unknown against a central band with softened edges."""
    width = F.greatest(q3 - q1, F.lit(1e-9))
    return (
        F.when(share.isNull() | q1.isNull() | q3.isNull() | (n < min_n), "unknown")
        .when(share.between(q1 - eps, q3 + eps), "good")
        .when(share.between(q1 - whisker * width, q3 + whisker * width), "warn")
        .otherwise("bad")
    )


def match_tier(score: Column, margin: Column, high: float, medium: float, low: float, min_margin: float) -> Column:
    """high, medium, low or unresolved."""
    return F.when((score >= high) & (margin >= min_margin), "high").when(score >= medium, "medium").when(score >= low, "low").otherwise("unresolved")


def clamp_count(n: Column, share: float = 0.2, least: int = 3, most: int = 15) -> Column:
    """ceil(share * n) between two bounds."""
    return F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(F.lit(share) * n)))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)
