"""Fuzzy ratios of two texts, as vectorised functions over Arrow batches.  Spark has no longest common
subsequence, so each pair is one small call; filter pairs by cheaper scores first."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from millrace.functions import scores

# The weights of the lexical blend.
OVERLAP_WEIGHT, FUZZY_WEIGHT = 0.70, 0.30


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence; one whole number holds a column of the table as bits."""
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    open_ = full
    for c in b:
        met = open_ & places.get(c, 0)
        open_ = ((open_ + met) | (open_ - met)) & full
    return len(a) - open_.bit_count()


def token_set_percent(a: str | None, b: str | None) -> float:
    """0 to 100: the best of three ratios between the shared words, and these with the other words of
    either side; a text whose words all occur in the other gives 100, one without words 0."""
    x, y = set((a or "").split()), set((b or "").split())
    if not x or not y:
        return 0.0
    shared = x & y
    if shared and (x <= y or y <= x):
        return 100.0
    only_x, only_y = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    base = len(" ".join(sorted(shared)))
    joint = 1 if shared else 0
    whole_x, whole_y = base + joint + len(only_x), base + joint + len(only_y)
    edits = len(only_x) + len(only_y) - 2 * common_subsequence(only_x, only_y)
    best = 1 - edits / (whole_x + whole_y)
    if shared:
        best = max(best, 1 - (1 + len(only_x)) / (base + whole_x), 1 - (1 + len(only_y)) / (base + whole_y))
    return 100.0 * best


@F.pandas_udf(DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """``token_set_percent`` of two text columns; nulls count as empty."""
    return pd.Series([token_set_percent(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the characters in matching blocks, longest block first, over both lengths."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype="float64")


def label_score(term: Column, label: Column) -> Column:
    """``scores.label_match`` with the sequence ratio as the last rule.  Spark evaluates a Python function
    for every row of its input, so rows that an earlier rule settles pass empty texts."""
    t, s = (F.regexp_replace(F.lower(F.trim(x)), r"\s+", " ") for x in (term, label))
    settled = (t == "") | (s == "") | F.contains(s, t)
    blank = lambda x: F.when(~settled, x).otherwise("")
    return F.when(settled, scores.label_match(term, label)).otherwise(sequence_ratio(blank(t), blank(s)))


def lexical_overlap(query_tokens: Column, food_tokens: Column, food_text: Column) -> Column:
    """F-beta of the tokens blended with the token-set ratio of the sorted query tokens and the food's text;
    0 without query tokens."""
    ratio = token_set_ratio(F.array_join(F.array_sort(query_tokens), " "), food_text) / 100
    return F.when(F.size(query_tokens) == 0, 0.0).otherwise(OVERLAP_WEIGHT * scores.f_beta(query_tokens, food_tokens) + FUZZY_WEIGHT * ratio)
