"""Column functions that read ingredient lines: amounts, units, sizes, preparation, kinds of amount."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scores import GRAMS_PER_UNIT, ML_PER_UNIT, unit_size
from millrace.functions.text import quantity

# Units with their common spellings, and word lists that results depend on.
UNIT_SPELLINGS = {
    "teaspoon": ("teaspoon", "teaspoons", "tsp", "tsps", "t"),
    "tablespoon": ("tablespoon", "tablespoons", "tbsp", "tbsps", "tbs", "tbl"),
    "cup": ("cup", "cups", "c"),
    "pint": ("pint", "pints", "pt", "pts"),
    "quart": ("quart", "quarts", "qt", "qts"),
    "gallon": ("gallon", "gallons", "gal"),
    "milliliter": ("milliliter", "milliliters", "ml"),
    "liter": ("liter", "liters", "litre", "litres", "l"),
    "gram": ("gram", "grams", "g", "gm"),
    "kilogram": ("kilogram", "kilograms", "kg"),
    "ounce": ("ounce", "ounces", "oz"),
    "pound": ("pound", "pounds", "lb", "lbs"),
    "can": ("can", "cans"),
    "package": ("package", "packages", "pkg", "pkgs"),
    "box": ("box", "boxes"),
    "jar": ("jar", "jars"),
    "bottle": ("bottle", "bottles"),
    "stick": ("stick", "sticks"),
    "slice": ("slice", "slices"),
    "piece": ("piece", "pieces"),
    "clove": ("clove", "cloves"),
    "bunch": ("bunch", "bunches"),
    "sprig": ("sprig", "sprigs"),
    "pinch": ("pinch", "pinches"),
    "dash": ("dash", "dashes"),
    "each": ("each", "ea"),
}
CASED_UNITS = {"T": "tablespoon", "L": "liter"}
MICRO_UNITS = ("pinch", "dash")
VAGUE_UNITS = ("bunch", "sprig")
SIZE_WORDS = ("small", "medium", "large", "jumbo", "extra-large", "extra", "whole")
PREPARATION_WORDS = (
    "chopped", "diced", "minced", "sliced", "crushed", "grated", "shredded", "beaten", "melted", "softened", "drained",
    "rinsed", "peeled", "cooked", "uncooked", "fresh", "frozen", "dry", "dried", "ground",
)
LINE_PATTERN = r"(?i)^(\d+\s+\d+/\d+|\d+/\d+|\d+(?:\.\d+)?|a|an|one|two|three|four)\s+([A-Za-z.]+)?\s*(.*)$"
BRACKETED_MASS = (
    r"(?i)\(\s*(?:about|approx(?:\.|imately)?|around)?\s*(\d+(?:\.\d+)?(?:\s+\d+/\d+)?|\d+/\d+)\s*"
    r"(oz|ounce|ounces|lb|lbs|pound|pounds|g|gram|grams|kg|kilogram|kilograms)\s*\.?\s*\)"
)
VAGUE_AMOUNT = r"(?i)\b(a bit|some|few|handful|pinch|dash)\s+of\b"
COMPOUND_NAME = r"(?i)\b(?:fresh\s+)?\w[\w\s-]*\s+and\s+\w[\w\s-]+\b"
SIZED_CONTAINER = r"(?i)\b(small|medium|large)\s+(box|bag|package|pkg|can|jar|bottle)\b"
NUMBER_WORDS = {"a": 1.0, "an": 1.0, "one": 1.0, "two": 2.0, "three": 3.0, "four": 4.0}

#: spelling -> unit, in one flat table.
UNIT_OF = {spelling: unit for unit, spellings in UNIT_SPELLINGS.items() for spelling in spellings}


def _lookup(table: dict, key: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.try_element_at(pairs, key)


def unit_name(word: Column) -> Column:
    """The unit that a word spells; ``T`` and ``L`` by case, else case and full stops do not count; null if none."""
    bare = F.replace(word, F.lit("."), F.lit(""))
    return F.coalesce(_lookup(CASED_UNITS, bare), _lookup(UNIT_OF, F.lower(bare)))


def units_in_text(text: Column) -> Column:
    """The text with each word that spells a unit replaced by the unit."""
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.coalesce(unit_name(w), w)), " ")


def amount(text: Column) -> Column:
    """``1 1/2``, ``3/4``, ``2.5`` and small number words; null for anything else, also a zero denominator."""
    t = F.lower(F.trim(text))
    return F.coalesce(quantity(t), _lookup(NUMBER_WORDS, t))


def parsed_line(raw: Column) -> Column:
    """Struct of quantity, unit, size, name, preparation, status, confidence by rules alone.

    Without a leading amount the whole line is the name; an unknown unit word belongs to the name and
    a size word stands for a count.  For whole tables take ``parsed_lines``, which evaluates each step once.
    """
    line = _line(raw)
    found, amount_text, word, rest = _groups(line)
    unit = F.when(found, unit_name(word))
    sized, name = _sized(found, unit, word), _name(line, found, unit, word, rest)
    return F.struct(*_fields(found, amount(amount_text), word, unit, sized, name))


def parsed_lines(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """``rows`` with the fields of ``parsed_line`` as columns.

    Every step is a column of its own that later steps use more than once, so Spark does not inline it: the pattern
    of a line is matched four times a row, while ``parsed_line`` repeats it wherever a part is mentioned.
    """
    c = lambda name: F.col(f"_{name}")
    found, amount_text, word, rest = _groups(c("line"))
    steps = [
        {"line": _line(F.col(raw))},
        {"found": found, "amount": amount_text, "word": word, "rest": rest},
        {"quantity": amount(c("amount")), "unit": F.when(c("found"), unit_name(c("word")))},
        {"sized": _sized(c("found"), c("unit"), c("word")), "name": _name(c("line"), c("found"), c("unit"), c("word"), c("rest"))},
    ]
    staged = rows
    for step in steps:
        staged = staged.select("*", *[expression.alias(f"_{name}") for name, expression in step.items()])
    return staged.select(*rows.columns, *_fields(c("found"), c("quantity"), c("word"), c("unit"), c("sized"), c("name")))


def _line(raw: Column) -> Column:
    return F.regexp_replace(F.trim(raw), r"\s+", " ")


def _groups(line: Column) -> tuple[Column, Column, Column, Column]:
    part = lambda k: F.regexp_extract(line, LINE_PATTERN, k)
    return line.rlike(LINE_PATTERN), part(1), part(2), F.trim(part(3))


def _sized(found: Column, unit: Column, word: Column) -> Column:
    return found & unit.isNull() & F.lower(F.replace(word, F.lit("."), F.lit(""))).isin(*SIZE_WORDS)


def _name(line: Column, found: Column, unit: Column, word: Column, rest: Column) -> Column:
    sized = _sized(found, unit, word)
    return F.when(~found, line).when(sized | unit.isNotNull(), rest).otherwise(F.trim(F.concat(word, F.lit(" "), rest)))


def _fields(found: Column, quantity_: Column, word: Column, unit: Column, sized: Column, name: Column) -> list[Column]:
    status = (
        F.when(~found, "no_quantity").when(sized, "parsed_size_as_count").when(unit.isNull(), "quantity_no_known_unit").otherwise("parsed")
    )
    words = F.split(F.replace(F.lower(name), F.lit(","), F.lit("")), " ")
    preparation = F.array_join(F.array_sort(F.array_intersect(words, F.array(*[F.lit(w) for w in PREPARATION_WORDS]))), ", ")
    kept = F.filter(F.split(name, " "), lambda w: ~F.lower(F.btrim(w, F.lit(","))).isin(*PREPARATION_WORDS))
    plain = F.btrim(F.array_join(kept, " "), F.lit(" ,"))
    return [
        F.when(found, quantity_).alias("quantity"),
        F.when(found, F.coalesce(unit, F.lit("each"))).alias("unit"),
        F.when(sized, F.lower(F.replace(word, F.lit("."), F.lit("")))).alias("size"),
        F.when(found & (plain != ""), plain).otherwise(name).alias("name"),
        F.when(found & (preparation != ""), preparation).alias("preparation"),
        status.alias("status"),
        F.when(status == "parsed", 0.9).when(status == "no_quantity", 0.35).when(status == "quantity_no_known_unit", 0.6).otherwise(0.8).alias("confidence"),
    ]


def bracketed_grams(raw: Column) -> Column:
    """Grams of a mass in brackets, such as ``(about 8 oz.)``; null without one."""
    unit = unit_name(F.regexp_extract(raw, BRACKETED_MASS, 2))
    return F.when(raw.rlike(BRACKETED_MASS), amount(F.regexp_extract(raw, BRACKETED_MASS, 1)) * unit_size(unit, GRAMS_PER_UNIT))


def with_bracketed_grams(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """``rows`` with ``bracketed``, the grams of ``bracketed_grams``, through steps as in ``parsed_lines``."""
    part = lambda k: F.regexp_extract(raw, BRACKETED_MASS, k)
    staged = rows.select("*", F.col(raw).rlike(BRACKETED_MASS).alias("_has_mass"), F.lower(F.trim(part(1))).alias("_mass"), part(2).alias("_mass_unit"))
    grams = F.when(F.col("_has_mass"), amount(F.col("_mass")) * unit_size(unit_name(F.col("_mass_unit")), GRAMS_PER_UNIT))
    return staged.select(*rows.columns, grams.alias("bracketed"))


def unit_kind(unit: Column) -> Column:
    """volume, mass, count or null."""
    counts = [u for u in UNIT_SPELLINGS if u not in ML_PER_UNIT and u not in GRAMS_PER_UNIT]
    return F.when(unit.isin(*ML_PER_UNIT), "volume").when(unit.isin(*GRAMS_PER_UNIT), "mass").when(unit.isin(*counts), "count")


def amount_kind(quantity: Column, unit: Column, name: Column) -> Column:
    """mass, volume, count, unmeasurable or unknown; pinches are volumes, bunches are unknown."""
    return (
        F.when(quantity.isNull(), "unmeasurable")
        .when(unit.isin(*MICRO_UNITS), "volume")
        .when(unit.isin(*VAGUE_UNITS), "unknown")
        .when(unit.isNotNull(), F.coalesce(unit_kind(unit), F.lit("unknown")))
        .when(F.trim(F.coalesce(name, F.lit(""))) != "", "count")
        .otherwise("unknown")
    )
