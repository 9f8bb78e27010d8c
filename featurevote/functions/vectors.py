"""Column expressions on fixed-width feature arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F

from featurevote.values import FEATURE_WIDTH

__all__ = [
    "array_to_vector",
    "vector_to_array",
    "pad_to_width",
    "or_zero_vector",
    "as_doubles",
    "linear_score",
    "logistic",
    "rounded_mean",
    "standardized",
]


def as_doubles(array: Column) -> Column:
    return array.cast("array<double>")


def pad_to_width(array: Column, width: int = FEATURE_WIDTH) -> Column:
    """Append zeros up to ``width``; cut what lies beyond it."""
    missing = F.greatest(F.lit(width) - F.size(array), F.lit(0))
    return F.slice(F.concat(as_doubles(array), F.array_repeat(F.lit(0.0), missing)), 1, width)


def or_zero_vector(array: Column, width: int = FEATURE_WIDTH) -> Column:
    """The array, or all zeros when it is NULL."""
    return F.coalesce(as_doubles(array), F.array_repeat(F.lit(0.0), width))


def linear_score(array: Column, weights: Sequence[float], intercept: float = 0.0) -> Column:
    """Dot product of a feature array with fixed weights, plus an intercept."""
    fixed = F.array(*[F.lit(float(w)) for w in weights])
    products = F.zip_with(as_doubles(array), fixed, lambda x, w: x * w)
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p) + F.lit(float(intercept))


def logistic(score: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def rounded_mean(columns: Sequence[Column]) -> Column:
    """Mean of hard 0/1 votes rounded half up, so an even split counts as 1."""
    total = columns[0].cast("double")
    for column in columns[1:]:
        total = total + column.cast("double")
    return F.round(total / F.lit(float(len(columns))))


def standardized(value: Column, mean: float, std: float, full_scale: float = 255.0) -> Column:
    """Scale a byte value to [0, 1] and standardize it by a fixed mean and deviation."""
    return (value / F.lit(full_scale) - F.lit(mean)) / F.lit(std)
