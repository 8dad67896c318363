"""Portion rows of foods: their kinds, scores for a recipe unit, and the ladder from a line's amount to grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import parsing, scores, text

# Unit names that say nothing, names that stand for masses, words and sizes that results depend on.
SAYS_NOTHING = ("undetermined", "racc")
MASS_NAMES = ("oz", "lb", "paired cooked w", "paired raw w", "dripping w", "orig ckd g", "orig rw g")
MASS_WORD = r"\b(oz|ounce|ounces|lb|lbs|pound|pounds|g|gram|grams|kg)\b"
FLUID_OUNCE = r"\b(fl\.?\s*oz|fluid\s+ounces?)\b"
VOLUME_WORD = (
    r"\b(cups?|tbsp|tablespoons?|tsp|teaspoons?|fl\.?\s*oz|fluid\s+ounces?|lit(?:er|re)s?|ml|milliliters?|pints?|quarts?|gallons?|"
    r"cc|cubic\s+centimeters?|cubic\s+cm|cubic\s+inch(?:es)?)\b"
)
VOLUME_UNITS = {
    r"cups?": "cup", r"tbsp|tablespoons?": "tablespoon", r"tsp|teaspoons?": "teaspoon", r"fl.*|fluid.*": "fluid_ounce",
    r"lit(?:er|re)s?": "liter", r"ml|milliliters?|cc|cubic\s+c.*": "milliliter", r"pints?": "pint", r"quarts?": "quart",
    r"gallons?": "gallon", r"cubic\s+inch(?:es)?": "cubic_inch",
}
LEADING_AMOUNT = r"^\s*(\d+(?:\.\d+)?(?:\s+\d+/\d+)?)\s+"
COUNTED = r"^\s*\d+(?:\.\d+)?(?:\s+\d+/\d+)?\s+([a-z][a-z\s,/-]{0,40}?)\s*$"
LABEL_LENGTH = 80
SIZES = ("small", "medium", "large", "extra-large", "jumbo")
SIZE_ONLY = (*SIZES, "slice")
SIZE_LADDER = ("medium", "large", "small", "extra-large", "jumbo")
CONTAINERS = ("can", "jar", "box", "package", "bottle")
WHOLE_WORDS = r"unpeeled|peeled|whole|approx|yield"
SERVING_WORDS = r"serving|servings|racc|undetermined"
EXACT_UNIT, READABLE, NO_CODE, MOST_POINTS, SEQ_STEP = 100.0, 10.0, 5.0, 50, 0.01
SIZE_IN_MODIFIER, SIZE_ANYWHERE, LABEL_EXACT, LABEL_TOKEN, LABEL_WORD, TEXT_WORD = 70.0, 45.0, 100.0, 80.0, 40.0, 35.0
NAME_IN_MODIFIER, WHOLE_WORD, PROXY_SIZE = 10.0, 5.0, 20.0


def volume_unit(field: Column) -> Column:
    """The first volume unit that a text names; null if none."""
    word = F.regexp_extract(F.lower(field), VOLUME_WORD, 1)
    out = F.lit(None).cast("string")
    for spelling, unit in reversed(VOLUME_UNITS.items()):
        out = F.when(word.rlike(f"^(?:{spelling})$"), unit).otherwise(out)
    return F.when(word != "", out)


def leading_amount(field: Column) -> Column:
    """The number, fractions included, that a text begins with; null if none."""
    return text.quantity(F.nullif(F.regexp_extract(field, LEADING_AMOUNT, 1), F.lit("")))


def _filled(c: str) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def classified(portions: DataFrame) -> DataFrame:
    """``portions`` with kind (volume, mass, count or other), ref_unit, ref_amount, label and readable.

    ``portions`` has food_id, portion_id, seq, data_points, gram_weight, amount, modifier, description and
    unit_name.  The unit name (if it says anything), the modifier (if it is no mere code) and the description
    are searched in this order; a row without grams is other.
    """
    name, modifier, description = _filled("unit_name"), _filled("modifier"), _filled("description")
    code = modifier.rlike(r"^\d+$")
    searched = [F.when((name != "") & ~F.lower(name).isin(*SAYS_NOTHING), name), F.when((modifier != "") & ~code, modifier), F.when(description != "", description)]
    fields = portions.withColumn("fields", F.array_compact(F.array(*searched)))
    volume = F.filter(F.transform("fields", lambda f: F.struct(volume_unit(f).alias("unit"), leading_amount(f).alias("amount"))), lambda v: v["unit"].isNotNull())
    massive = lambda f: F.lower(f).rlike(MASS_WORD) & ~F.lower(f).rlike(FLUID_OUNCE)
    labels = F.filter(F.transform("fields", lambda f: F.when(f.rlike(r"^\d+$"), F.lit(None)).otherwise(_label(f))), lambda x: x.isNotNull() & (x != ""))
    found = fields.withColumn("volume", F.try_element_at(volume, F.lit(1))).withColumn("label", F.try_element_at(labels, F.lit(1)))
    heavy = F.lower(name).isin(*MASS_NAMES) | F.exists("fields", massive)
    kind = (
        F.when(F.coalesce(F.col("gram_weight"), F.lit(0.0)) <= 0, "other").when(F.col("volume").isNotNull(), "volume")
        .when(heavy, "mass").when(F.col("label").isNotNull(), "count").otherwise("other")
    )
    one = F.when(F.col("amount") > 0, F.col("amount")).otherwise(1.0)
    readable = ((modifier != "") & ~code) | (description != "") | (name != "")
    out = found.withColumn("kind", kind)
    return out.select(
        *portions.columns, "kind", F.when(kind == "volume", F.col("volume.unit")).alias("ref_unit"),
        F.when(kind == "volume", F.coalesce("volume.amount", one)).otherwise(one).alias("ref_amount"),
        F.when(kind == "count", F.col("label")).alias("label"), readable.alias("readable"), code.alias("code_only"),
    )


def _label(field: Column) -> Column:
    low = F.lower(F.trim(field))
    counted = F.trim(F.regexp_extract(low, COUNTED, 1))
    return F.coalesce(parsing.unit_name(F.trim(field)), F.when(counted != "", counted), F.when(F.length(low) <= LABEL_LENGTH, low))


def _points() -> Column:
    return F.least(F.coalesce(F.col("data_points"), F.lit(0)), F.lit(MOST_POINTS)) - F.col("seq") * SEQ_STEP


def volume_score(unit: Column) -> Column:
    """How well a volume portion fits a recipe unit."""
    plain = ~F.col("code_only")
    return F.when(F.col("ref_unit") == unit, EXACT_UNIT).otherwise(0.0) + F.when(F.col("readable") & plain, READABLE).otherwise(0.0) + F.when(plain, NO_CODE).otherwise(0.0) + _points()


def _texts() -> tuple[Column, Column, Column]:
    return F.lower(F.coalesce("label", F.lit(""))), F.lower(_filled("modifier")), F.lower(_filled("description"))


def _has_size(size: Column) -> Column:
    every = F.concat_ws(" ", *_texts())
    return F.contains(every, size) | F.contains(every, F.replace(size, F.lit("-"), F.lit(" ")))


def count_score(unit: Column, size: Column) -> Column:
    """How well a count portion fits a line's unit and size; 0 where nothing fits."""
    label, modifier, description = _texts()
    word = F.concat(F.lit(r"\b"), unit, F.lit(r"\b"))
    by_unit = (
        F.when(label == unit, LABEL_EXACT).when(F.array_contains(F.split(label, r"[\s,/-]+"), unit), LABEL_TOKEN)
        .when(F.regexp_like(label, word), LABEL_WORD).when(F.regexp_like(modifier, word) | F.regexp_like(description, word), TEXT_WORD).otherwise(0.0)
    )
    in_modifier = F.contains(modifier, size) | F.contains(modifier, F.replace(size, F.lit("-"), F.lit(" ")))
    by_size = F.when(in_modifier, SIZE_IN_MODIFIER).when(F.contains(F.concat_ws(" ", label, modifier, description), size), SIZE_ANYWHERE).otherwise(0.0)
    fit = F.coalesce(F.when(unit.isNotNull() & ~unit.isin(*SIZES), by_unit), F.lit(0.0)) + F.coalesce(F.when(size.isin(*SIZES), by_size), F.lit(0.0))
    return F.when(fit > 0, fit + _points()).otherwise(0.0)


def resolved(lines: DataFrame, portions: DataFrame, key: list[str]) -> DataFrame:
    """(key, grams, status, portion_id, path) of every line.

    ``lines`` has food_id (null: no food), quantity, unit (null: none), size, name and bracketed (grams of a
    mass in brackets); ``portions`` comes from ``classified``.  The first path that holds wins: mass in
    brackets, mass unit, volume unit through the best volume portion, count through the best count
    portion, then through the size named, through the size ladder where a food's counts are sizes only,
    through a container's mass, through the mass of a whole item.  All portions of a line's food are met in one
    join and one aggregation.
    """
    unit, size, quantity = F.col("unit"), F.col("size"), F.col("quantity")
    met = lines.join(portions.withColumnRenamed("food_id", "of"), F.col("food_id") == F.col("of"), "left")
    kind, label = F.col("kind"), F.lower(F.trim(F.coalesce("label", F.lit(""))))
    first = (F.col("seq"), -F.coalesce(F.col("data_points"), F.lit(0)), F.col("portion_id"))
    row = [F.col(c) for c in ("portion_id", "gram_weight", "ref_amount", "ref_unit")]

    def best(condition: Column, *order: Column) -> Column:
        named = [c.alias(f"o{k}") for k, c in enumerate(order)]
        return F.min(F.when(condition, F.struct(*named, *row)))

    exact, is_count = count_score(unit, size), kind == "count"
    modifier = F.lower(_filled("modifier"))
    rung = F.coalesce(*[F.when(_has_size(F.lit(s)), k) for k, s in enumerate(SIZE_LADDER)])
    whole = (
        F.when((F.coalesce(F.col("name"), F.lit("")) != "") & F.contains(modifier, F.lower("name")), NAME_IN_MODIFIER).otherwise(0.0)
        + F.when(modifier.rlike(WHOLE_WORDS), WHOLE_WORD).otherwise(0.0)
        + F.when(size.isNotNull() & (F.contains(modifier, size) | F.contains(modifier, F.replace(size, F.lit("-"), F.lit(" ")))), PROXY_SIZE).otherwise(0.0)
    )
    serving = F.lower(F.concat_ws(" ", "label", "modifier", "description", "unit_name")).rlike(SERVING_WORDS)
    held = [c for c in ("food_id", "quantity", "unit", "size", "bracketed") if c not in key]
    made = met.groupBy(*key).agg(
        *[F.first(c).alias(c) for c in held],
        best(kind == "volume", (F.col("code_only") & ~F.col("readable")).cast("int"), (F.col("ref_unit") != unit).cast("int"), -volume_score(unit), *first).alias("volume"),
        best(is_count & (exact > 0), -exact, *first).alias("exact"),
        best(is_count & _has_size(size), *first).alias("sized"),
        best(is_count & rung.isNotNull(), rung, *first).alias("rung"),
        F.coalesce(F.min(F.when(is_count & (label != ""), label.isin(*SIZE_ONLY))), F.lit(True)).alias("size_only"),
        best(kind.isin("mass", "other") & (F.col("gram_weight") > 0) & unit.isin(*CONTAINERS) & F.contains(modifier, unit), *first).alias("container"),
        best((kind == "mass") & (modifier != ""), -whole, *first).alias("item"),
        F.coalesce(F.max(serving & kind.isin("mass", "count")) & F.min(F.when(is_count, serving).otherwise(True)), F.lit(False)).alias("serving_only"),
    )
    base = scores.convert(quantity, unit, F.lit("gram"))
    milliliters = lambda a, u: a * scores.unit_size(u, scores.ML_PER_UNIT)
    by_volume = milliliters(quantity, unit) / milliliters(F.col("volume.ref_amount"), F.col("volume.ref_unit")) * F.col("volume.gram_weight")
    times = lambda c: quantity / F.col(f"{c}.ref_amount") * F.col(f"{c}.gram_weight")
    plain = lambda c: quantity * F.col(f"{c}.gram_weight")
    is_volume, is_mass = scores.unit_size(unit, scores.ML_PER_UNIT).isNotNull(), scores.unit_size(unit, scores.GRAMS_PER_UNIT).isNotNull()
    counted = quantity.isNotNull() & ~is_volume & ~is_mass
    ladder = [
        ("bracketed", F.col("bracketed").isNotNull(), F.col("bracketed"), None),
        ("mass", is_mass & quantity.isNotNull(), base, None),
        ("volume", is_volume & quantity.isNotNull() & F.col("volume").isNotNull(), by_volume, "volume"),
        ("count", counted & F.col("exact").isNotNull(), times("exact"), "exact"),
        ("size", counted & F.col("sized").isNotNull(), times("sized"), "sized"),
        ("size_ladder", counted & size.isNull() & F.col("size_only") & F.col("rung").isNotNull(), times("rung"), "rung"),
        ("container", counted & F.col("container").isNotNull(), plain("container"), "container"),
        ("whole_item", counted & F.col("item").isNotNull(), plain("item"), "item"),
    ]
    known = F.col("food_id").isNotNull()
    path = F.coalesce(*[F.when(known & c, F.lit(n)) for n, c, _, _ in ladder], F.lit("none"))
    out = made.withColumn("path", path)
    grams, portion = F.lit(None).cast("double"), F.lit(None).cast("long")
    for n, _, g, p in reversed(ladder):
        grams = F.when(F.col("path") == n, g).otherwise(grams)
        portion = F.when(F.col("path") == n, F.col(f"{p}.portion_id") if p else F.lit(None).cast("long")).otherwise(portion)
    status = (
        F.when(~known, "missing_food").when(F.col("path").isin("bracketed", "mass"), "ok_embedded_mass").when(F.col("path") == "volume", "ok_volume_portion")
        .when(F.col("path") != "none", "ok_count_portion").when(quantity.isNull(), "no_quantity").when(counted & F.col("serving_only"), "unresolvable_serving_only").otherwise("no_portion")
    )
    return out.select(*key, F.round(grams, 4).alias("grams"), status.alias("status"), portion.alias("portion_id"), "path")
