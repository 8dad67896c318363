"""Column functions over food and recipe text.  ASCII classes are written out, so that every engine agrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units, word lists and irregular plurals that results depend on.
VOLUME_UNITS = (
    r"cups?|tsp|teaspoon|teaspoons|tbsp|tablespoon|tablespoons|fl\.?\s*oz|fluid\s+ounces?|liter|litre|liters|litres|"
    r"ml|milliliter|milliliters|pint|pints|quart|quarts|gallon|gallons|"
    r"cubic\s*inch|cubic\s*inches|cubic\s*centimeter|cubic\s*centimeters|cubic\s*cm|cc"
)
MASS_UNITS = r"(oz|ounce|ounces|lb|lbs|pound|pounds|g|gram|grams|kg|kilogram|mg|milligram)s?"
IRREGULAR_PLURALS = {"leaves": "leaf", "tomatoes": "tomato", "potatoes": "potato", "cherries": "cherry", "berries": "berry"}
STOP_WORDS = (
    "a", "an", "and", "as", "at", "by", "for", "from", "in", "into", "of", "on", "or", "per", "the", "to", "with", "without",
    "optional", "desired", "taste", "garnish", "serving",
)
MEASURE_WORDS = (
    r"\b(c|cup|cups|tbsp|tablespoon|tablespoons|tsp|teaspoon|teaspoons|oz|ounce|ounces|lb|lbs|pound|pounds|g|gram|grams|kg|ml|l|"
    r"pkg|package|packages|can|cans|jar|jars)\b"
)
BRACKETS, NUMBERS, NOT_LETTERS = r"\([^)]*\)", r"\d+\s*/\s*\d+|\d+\.\d+|\d+", r"[^a-z\s]"
CONTAINER_WORDS = (
    "pkg", "package", "can", "cans", "jar", "jars", "bottle", "bottles", "box", "boxes", "bag", "bags",
    "carton", "stick", "sticks", "slice", "slices", "piece", "pieces", "wedge", "wedges",
)


def normalize_description(text: Column) -> Column:
    """Lower case, runs of punctuation and white space as one space; null as empty.  Unicode-aware."""
    lowered = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.trim(F.regexp_replace(F.regexp_replace(lowered, r"[^\p{L}\p{N}_\s]+", " "), r"\s+", " "))


def has_volume(*parts: Column) -> Column:
    """Whether any part names a volume unit as a word of its own."""
    return F.concat_ws(" ", *parts).rlike(rf"(?i)\b({VOLUME_UNITS})\b")


def modifier_kind(text: Column) -> Column:
    """volume, mass or other; both kinds at once, numbers and blanks are other; fluid ounces are volume."""
    t = F.trim(F.coalesce(text, F.lit("")))
    volume, mass = t.rlike(rf"(?i)\b({VOLUME_UNITS})\b"), t.rlike(rf"(?i)\b{MASS_UNITS}\b")
    return (
        F.when((t == "") | t.rlike(r"^[0-9]+$"), "other")
        .when(t.rlike(r"(?i)\b(fl\.?\s*oz|fluid\s+ounces?)\b"), "volume")
        .when(mass & ~volume, "mass")
        .when(volume & ~mass, "volume")
        .otherwise("other")
    )


def singular(token: Column) -> Column:
    """Plural stripping with the irregular ones first."""
    t = F.lower(token)
    irregular = F.lit(None).cast("string")
    for plural, one in IRREGULAR_PLURALS.items():
        irregular = F.when(t == plural, one).otherwise(irregular)
    n = F.length(t)
    return (
        F.when(irregular.isNotNull(), irregular)
        .when((n > 4) & t.endswith("ies"), F.concat(F.substring(t, 1, n - 3), F.lit("y")))
        .when((n > 3) & t.endswith("es") & ~t.endswith("ses"), F.substring(t, 1, n - 2))
        .when((n > 3) & t.endswith("s") & ~t.endswith("ss"), F.substring(t, 1, n - 1))
        .otherwise(t)
    )


def tokens(text: Column, *, drop_stop: bool = True, drop_containers: bool = True) -> Column:
    """Distinct singular tokens of the normalized text, sorted; single letters go, digits stay."""
    raw = F.split(normalize_description(text), " ")
    dropped = [*(STOP_WORDS if drop_stop else ()), *(CONTAINER_WORDS if drop_containers else ())]
    keep = lambda x: (x != "") & ~x.isin(dropped) & ((F.length(x) > 1) | x.rlike(r"^[0-9]+$"))
    return F.array_sort(F.array_distinct(F.transform(F.filter(raw, keep), singular)))


def clean_ingredient(text: Column) -> Column:
    """Lower case without parentheses, numbers, unit words and anything but letters."""
    t = F.lower(F.coalesce(text, F.lit("")))
    for pattern in (BRACKETS, NUMBERS, MEASURE_WORDS, NOT_LETTERS):
        t = F.regexp_replace(t, pattern, " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def semantic_text(title: Column, ingredients: Column) -> Column:
    """``title | sorted ingredients``."""
    return F.concat(title, F.lit(" | "), F.array_join(F.array_sort(ingredients), " "))


def after_bar(text: Column) -> Column:
    """What follows the first bar, trimmed; without one, empty."""
    return F.trim(F.when(F.instr(text, "|") > 0, F.regexp_replace(text, r"(?s)^[^|]*\|", "")).otherwise(""))


def slug(text: Column) -> Column:
    """Lower case, anything but letters and digits as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def display_label(text: Column) -> Column:
    """Without parentheses, digits and dashes; null if nothing is left."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(text), BRACKETS, ""), r"\d+", ""), "[-–—]", " ")
    return F.nullif(F.trim(F.regexp_replace(t, r"\s+", " ")), F.lit(""))


def joined_label(*parts: Column) -> Column:
    """The parts that are not blank, trimmed, with bars between; null if there are none."""
    full = [F.nullif(F.trim(p), F.lit("")) for p in parts]
    return F.nullif(F.concat_ws(" | ", *full), F.lit(""))


def link_domain(url: Column) -> Column:
    """Host of a url without ``www.``."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1))
    return F.regexp_replace(host, r"^www\.", "")


def quantity(text: Column) -> Column:
    """Amounts such as ``1 1/2``, ``3/4`` and ``2.5``; null for anything else, also a zero denominator."""
    t = F.trim(text)
    number = lambda k, p: F.regexp_extract(t, p, k).try_cast("double")
    mixed, fraction = r"^(\d+)\s+(\d+)\s*/\s*(\d+)$", r"^(\d+)\s*/\s*(\d+)$"
    return (
        F.when(t.rlike(mixed), number(1, mixed) + F.try_divide(number(2, mixed), number(3, mixed)))
        .when(t.rlike(fraction), F.try_divide(number(1, fraction), number(2, fraction)))
        .when(t.rlike(r"^\d+(\.\d+)?$"), t.try_cast("double"))
    )
