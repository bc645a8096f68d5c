"""Vector expressions over array columns, in double precision and inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v) -> Column:
    """A vector column as array<double>."""
    return F.col(v).cast("array<double>") if isinstance(v, str) else v.cast("array<double>")


def dot(a, b) -> Column:
    """Sum of products; null where either is null or an element is."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """Cosine; null where a norm is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def normalise(a) -> Column:
    """To unit length; null elements where the norm is zero. The norm is an accumulator's result, so it is computed once a vector."""
    a = doubles(a)
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x, lambda s: F.transform(a, lambda x: F.when(s > 0, x / F.sqrt(s))))


def scale_sum(a, x: float, b, y: float) -> Column:
    """x*a + y*b, element-wise."""
    return F.zip_with(doubles(a), doubles(b), lambda p, q: p * x + q * y)


def softmax(scores, temperature: float = 1.0) -> Column:
    """Softmax of an array, shifted by its largest element so that it never overflows."""
    a = doubles(scores)
    return share(F.aggregate(a, F.lit(float("-inf")), lambda m, x: F.greatest(m, x), lambda m: F.transform(a, lambda x: F.exp((x - m) * temperature))))


def share(a) -> Column:
    """Elements over their sum; null elements where the sum is zero."""
    a = doubles(a)
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x, lambda total: F.transform(a, lambda x: F.when(total != 0, x / total)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def overlap(p, q) -> Column:
    """Bhattacharyya coefficient of two distributions."""
    return F.aggregate(F.zip_with(doubles(p), doubles(q), lambda x, y: F.sqrt(x * y)), F.lit(0.0), lambda s, x: s + x)


def argmax(a) -> Column:
    """Zero-based place of the largest element; the first one on ties."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def box_overlap(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    """Intersection over union of two boxes; zero where they don't meet or have no area."""
    w = F.greatest(F.lit(0.0), F.least(ax1, bx1) - F.greatest(ax0, bx0))
    h = F.greatest(F.lit(0.0), F.least(ay1, by1) - F.greatest(ay0, by0))
    both = w * h
    union = (ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))
