"""Comparisons of images by their signatures, and of vectors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
BINS, BIN_WIDTH, CHANGED = 32, 8, 15


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def histogram(values: Column) -> Column:
    """Counts of 0..255 values in BINS bins."""
    return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.size(F.filter(values, lambda v: F.floor(v / BIN_WIDTH) == b)).cast("double"))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's correlation. 1 where both are constant, 0 where one is, or where one is null or empty."""
    n = F.size(a).cast("double")
    mean = lambda x: total(x) / n
    cross = total(F.zip_with(a, b, lambda x, y: x * y)) / n - mean(a) * mean(b)
    spread = lambda x: total(F.transform(x, lambda v: v * v)) / n - mean(x) * mean(x)
    va, vb = spread(a), spread(b)
    flat = F.lit(1e-12)
    return F.when(F.coalesce(F.size(a), F.lit(-1)) <= 0, 0.0).when(F.coalesce(F.size(b), F.lit(-1)) != F.size(a), 0.0).when((va <= flat) & (vb <= flat), 1.0).when((va <= flat) | (vb <= flat), 0.0).otherwise(cross / F.sqrt(va * vb))


def mean_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of 0..255 values, from 0 to 1; 1 where one is missing."""
    return F.coalesce(total(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))) / F.nullif(F.size(a).cast("double"), F.lit(0.0)) / 255.0, F.lit(1.0))


def colour_similarity(a: Column, b: Column) -> Column:
    """Mean correlation of the channels' histograms, mapped to 0..1; 0 where one is missing."""
    mean = F.aggregate(F.zip_with(a, b, correlation), F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(a), F.lit(0))
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (mean + 1) / 2)), F.lit(0.0))


def changed_ratio(a: Column, b: Column, threshold: int = CHANGED) -> Column:
    """Share of values that differ by more than the threshold; 1 where one is missing or empty."""
    return F.coalesce(F.size(F.filter(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda d: d > threshold)).cast("double") / F.nullif(F.size(a).cast("double"), F.lit(0.0)), F.lit(1.0))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector, never NaN."""
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(1e-10))
