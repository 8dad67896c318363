"""Staged match scores: literal cases of every rule."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import staged


def words(*found):
    return F.array(*map(F.lit, found)).cast("array<string>")


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("query", "food", "bonus", "rules", "penalty"),
    [
        ((), ("raw",), 1.0, 0.5, 0.0),
        ((), (), 0.9, 0.5, 0.0),
        ((), ("spicy",), 0.2, 0.5, 0.25),
        ((), ("garlic", "smoked", "raw"), 0.2, 0.5, 0.5),
        (("spicy",), ("spicy", "raw"), 0.5, 1.0, 0.08),
        (("spicy",), ("raw",), 0.2, 0.0, 0.08),
        (("chopped", "raw"), ("diced", "raw"), 1.0, 0.5, 0.08),
        (("raw",), ("diced", "cooked", "canned", "frozen", "fresh"), 1.0, 0.0, 0.24),
    ],
)
def test_modifier_rules(spark, query, food, bonus, rules, penalty):
    q, f = staged.modifiers(words(*query)), staged.modifiers(words(*food))
    assert value(spark, staged.default_bonus(q, f)) == bonus
    assert value(spark, staged.rule_score(q, f)) == rules
    assert value(spark, staged.modifier_penalty(q, f, words("gear"))) == pytest.approx(penalty)


def test_words_of_the_base_are_no_extra_modifiers(spark):
    q, f = staged.modifiers(words("raw")), staged.modifiers(words("raw", "whole"))
    assert value(spark, staged.modifier_penalty(q, f, words("whole"))) == 0.0


@pytest.mark.parametrize(
    ("base", "prep", "asked", "food", "reason"),
    [
        (0.34, 0.9, ("raw",), ("raw",), "weak_base"),
        (0.35, 0.5, ("raw",), ("raw",), "exact_prep"),
        (0.9, 0.2, (), ("fresh",), "neutral_default"),
        (0.9, 0.2, (), (), "neutral_default"),
        (0.9, 0.34, ("raw",), (), "prep_fallback"),
        (0.9, 0.4, ("raw",), (), "base_only"),
        (0.9, 0.9, (), ("spicy",), "unsupported_flavor_last_resort"),
        (0.9, 0.9, (), ("canned",), "base_only"),
    ],
)
def test_reasons(spark, base, prep, asked, food, reason):
    assert value(spark, staged.fallback(F.lit(base), F.lit(prep), words(*asked), staged.modifiers(words(*food)))) == reason


def test_blend_and_unknown_similarity(spark):
    none = F.lit(None).cast("double")
    assert value(spark, staged.base_score(F.lit(1.0), none, F.lit(0.5), F.lit(2.0))) == pytest.approx(0.3 * 0.8 + 0.7 * (0.4 + 0.2))
    empty = staged.modifiers(words())
    assert value(spark, staged.prep_score(words(), none, empty, empty)) == pytest.approx(0.4 * 0.5 + 0.3 * 0.5 + 0.2 * 0.5 + 0.1 * 0.9)
    assert value(spark, staged.prep_score(words(), F.lit(-0.5), empty, empty)) == pytest.approx(0.2 + 0.15 + 0.1 + 0.09)
    assert value(spark, staged.final_score(F.lit(0.1), F.lit(0.1), F.lit(0.2), F.lit(0.9))) == 0.0
