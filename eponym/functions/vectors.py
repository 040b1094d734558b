"""Vector and score expressions over arrays (inventory V1 to V9, V13, V14, A12, A13)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def normalized(a: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    return F.element_at(F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x.cast("double") / n))), 1)


def rounded(a: Column, digits: int = 8) -> Column:
    return F.transform(a, lambda x: F.round(x, digits))


def harmonic_mean(x: Column, y: Column) -> Column:
    return F.when((x <= 0) | (y <= 0), F.lit(0.0)).otherwise(2 / (1 / x + 1 / y))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def cluster_weight(frequency: Column) -> Column:
    """max(1, floor(ln(max(1, frequency))))."""
    return F.greatest(F.lit(1), F.floor(F.log(F.greatest(F.lit(1), frequency))))


def smoothed_score(f: Column, tree_total: Column, record_total: Column, smooth: float = 20.0, lift: float = 0.38) -> Column:
    m = F.greatest((f + smooth) / (tree_total + smooth), (f + smooth) / (record_total + smooth))
    return m + lift * (1 - m)


def log_line(x1: float, y1: float, x2: float, y2: float, low: float, high: float):
    """A threshold linear in log(frequency) through two points, held between two bounds."""
    from math import log

    slope = (y2 - y1) / (log(x2) - log(x1)) if x1 != x2 else 0.0
    start = y1 - slope * log(x1)
    return lambda frequency: clamp(slope * F.log(frequency.cast("double")) + start, low, high)


def ensemble_features(vector_score: Column, edit_score: Column, input_frequency: Column, candidate_frequency: Column, unknown: Column) -> Column:
    """Eleven features: scores alone and times the logs of the larger and the smaller frequency, in a block for known and one for unknown names."""
    more = F.log10(F.greatest(input_frequency, candidate_frequency) + 1.0)
    less = F.log10(F.least(input_frequency, candidate_frequency) + 1.0)
    one = F.lit(1.0)
    weights = (one, more, less)
    known_block = [F.when(~unknown, s * w).otherwise(0.0) for s in (vector_score, edit_score) for w in weights] + [F.when(~unknown, one).otherwise(0.0)]
    unknown_block = [F.when(unknown, edit_score * w).otherwise(0.0) for w in weights] + [F.when(unknown, one).otherwise(0.0)]
    return F.array(*known_block, *unknown_block)


def logistic_score(features: Column, weights: list[float]) -> Column:
    """Probability of a logistic model without constant."""
    z = sum((F.element_at(features, k + 1) * F.lit(float(w)) for k, w in enumerate(weights)), F.lit(0.0))
    return 1 / (1 + F.exp(-z))
