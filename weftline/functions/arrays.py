"""Array expressions: set similarities, number variants, digit repair."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.constants import DIGITS, LETTERS


def jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection over size of the union; 0 if both are empty or one is null."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Size of the intersection over the length of the shorter list; 0 if it is empty or null."""
    shorter = F.when(a.isNotNull() & b.isNotNull(), F.least(F.size(a), F.size(b)))
    return F.when(shorter > 0, F.size(F.array_intersect(a, b)) / shorter).otherwise(F.lit(0.0))


def without_first_digit(x: Column) -> Column:
    """257 to 57, 208 to 8, 5 to 0."""
    return x % F.pow(F.lit(10.0), F.floor(F.log10(x.cast("double")) + 1e-9)).cast("long")


def with_short_numbers(numbers: Column) -> Column:
    """Numbers and what is left of them without the first digit, sorted; zeros dropped."""
    return F.array_sort(F.array_distinct(F.filter(F.concat(numbers, F.transform(numbers, without_first_digit)), lambda x: x > 0)))


def digits_to_letters(words: Column) -> Column:
    """Digits that stand for letters are repaired in words that have a letter."""
    return F.transform(words, lambda w: F.when(w.rlike("[a-z]"), F.translate(w, DIGITS, LETTERS)).otherwise(w))


def joined(words: Column, sep: str = "") -> Column:
    return F.array_join(words, sep)
