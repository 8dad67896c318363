"""Two-stage match score: what a food is (base), then how it is prepared, with a penalty for modifiers nobody asked for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Modifier words by class, weights, penalties and bounds.
MODIFIERS = {
    "physical_form": ("boneless", "skinless", "chopped", "ground", "sliced", "diced", "minced", "grated", "shredded", "cubed", "whole", "fillet", "breast", "thigh", "drumstick", "wing"),
    "cooking_state": ("raw", "cooked", "grilled", "fried", "roasted", "boiled", "baked", "steamed", "poached", "braised"),
    "flavor_style": (
        "spicy", "thai", "bbq", "teriyaki", "breaded", "fried", "seasoned", "restaurant", "brand", "smoked",
        "honey", "garlic", "buffalo", "ranch", "cajun", "lemon", "pepper", "mesquite",
    ),
    "packaging": ("canned", "frozen", "dried", "dehydrated", "powdered", "instant", "smoked", "cured"),
    "default_like": ("raw", "unseasoned", "boneless", "skinless", "generic", "uncooked", "fresh", "plain", "natural", "unprepared"),
}
RULED = ("physical_form", "cooking_state", "packaging", "flavor_style")
LEXICAL, SEMANTIC, NAME, FULL_TEXT = 0.80, 0.20, 0.30, 0.70
PREP_SEMANTIC, PREP_LEXICAL, PREP_RULES, PREP_DEFAULT = 0.40, 0.30, 0.20, 0.10
FINAL_BASE, FINAL_PREP, FINAL_DEFAULT = 0.65, 0.25, 0.10
UNASKED_FLAVOR, EXTRA_MODIFIER, MOST_EXTRA = 0.25, 0.08, 3
UNKNOWN = 0.5
WEAK_BASE, WEAK_PREP, GOOD_PREP = 0.35, 0.35, 0.5


def modifiers(tokens: Column) -> Column:
    """Struct of the tokens' modifier words by class, as arrays."""
    return F.struct(*[F.array_intersect(tokens, F.array(*map(F.lit, words))).alias(name) for name, words in MODIFIERS.items()])


def all_modifiers(classes: Column) -> Column:
    return F.array_distinct(F.flatten(F.array(*[classes[name] for name in MODIFIERS])))


def _held(similarity: Column) -> Column:
    return F.least(F.greatest(similarity, F.lit(0.0)), F.lit(1.0))


def base_score(name_lexical: Column, name_similarity: Column, full_lexical: Column, full_similarity: Column) -> Column:
    """Names and full texts, each by words and by vectors; an unknown similarity counts 0."""
    channel = lambda words, near: LEXICAL * words + SEMANTIC * F.coalesce(_held(near), F.lit(0.0))
    return NAME * channel(name_lexical, name_similarity) + FULL_TEXT * channel(full_lexical, full_similarity)


def default_bonus(query: Column, food: Column) -> Column:
    """1 for a plain food where no flavour is asked, 0.9 for one without modifiers, 0.5 where a flavour is met, else 0.2."""
    asked = F.size(query["flavor_style"]) > 0
    return (
        F.when(~asked & (F.size(food["default_like"]) > 0) & (F.size(food["flavor_style"]) == 0), 1.0)
        .when(~asked & (F.size(all_modifiers(food)) == 0), 0.9)
        .when(asked & F.arrays_overlap(query["flavor_style"], all_modifiers(food)), 0.5)
        .otherwise(0.2)
    )


def rule_score(query: Column, food: Column) -> Column:
    """Share of the modifier classes asked for that the food meets; 0.5 if none is."""
    asked = sum(((F.size(query[c]) > 0).cast("int") for c in RULED), F.lit(0))
    met = sum((F.arrays_overlap(query[c], food[c]).cast("int") for c in RULED), F.lit(0))
    return F.when(asked == 0, UNKNOWN).otherwise(F.try_divide(met, asked))


def prep_score(prep_tokens: Column, similarity: Column, query: Column, food: Column) -> Column:
    """Preparation by vectors, words, rules and default; unknown or zero similarity and no words count 0.5."""
    n = F.size(prep_tokens)
    lexical = F.when(n == 0, UNKNOWN).otherwise(F.try_divide(F.size(F.array_intersect(prep_tokens, all_modifiers(food))), n))
    near = F.coalesce(F.nullif(_held(similarity), F.lit(0.0)), F.lit(UNKNOWN))
    return PREP_SEMANTIC * near + PREP_LEXICAL * lexical + PREP_RULES * rule_score(query, food) + PREP_DEFAULT * default_bonus(query, food)


def modifier_penalty(query: Column, food: Column, base_tokens: Column) -> Column:
    """For flavours where none is asked, and for up to three further modifiers where some are."""
    flavors = F.size(F.array_except(food["flavor_style"], query["flavor_style"]))
    wanted = all_modifiers(query)
    extra = F.size(F.array_except(F.array_except(all_modifiers(food), wanted), base_tokens))
    unasked = F.when(F.size(query["flavor_style"]) == 0, UNASKED_FLAVOR * flavors).otherwise(0.0)
    return unasked + F.when(F.size(wanted) > 0, EXTRA_MODIFIER * F.least(F.lit(MOST_EXTRA), extra)).otherwise(0.0)


def final_score(base: Column, prep: Column, bonus: Column, penalty: Column) -> Column:
    """The blend less the penalty, held to 0 and 1."""
    return _held(FINAL_BASE * base + FINAL_PREP * prep + FINAL_DEFAULT * bonus - penalty)


def fallback(base: Column, prep: Column, prep_tokens: Column, food: Column) -> Column:
    """Why the food was taken."""
    asked, every = F.size(prep_tokens) > 0, F.size(all_modifiers(food))
    return (
        F.when(base < WEAK_BASE, "weak_base")
        .when(asked & (prep >= GOOD_PREP), "exact_prep")
        .when(~asked & ((F.size(food["default_like"]) > 0) | (every == 0)), "neutral_default")
        .when(asked & (prep < WEAK_PREP), "prep_fallback")
        .when((F.size(food["flavor_style"]) > 0) & ~asked, "unsupported_flavor_last_resort")
        .otherwise("base_only")
    )
