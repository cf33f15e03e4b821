"""Vector arithmetic on array columns, in double precision inside codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def unit(a: Column) -> Column:
    """Scaled to length one; NULL for the zero vector."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def is_unit(a: Column, tolerance: float = 1e-5) -> Column:
    return F.abs(norm(a) - 1.0) <= tolerance


def pick(a: Column, positions: Column) -> Column:
    """Elements at zero-based positions: a reorder or channel map."""
    return F.transform(positions, lambda i: F.element_at(a, (i + 1).cast("int")))


def permute_blocks(a: Column, permutation: Column, width: int) -> Column:
    """Move whole blocks of ``width`` elements; block j of the result is block permutation[j]."""
    return F.flatten(
        F.transform(permutation, lambda p: F.slice(a, (p * width + 1).cast("int"), F.lit(width)))
    )


def transpose(m: Column) -> Column:
    """Swap the two axes of an array of equal-length arrays."""
    return F.transform(
        F.sequence(F.lit(1), F.size(F.element_at(m, 1))),
        lambda j: F.transform(m, lambda row: F.element_at(row, j)),
    )


def pad(a: Column, length: Column, fill) -> Column:
    """Right-pad with ``fill`` up to ``length``."""
    return F.concat(a, F.array_repeat(F.lit(fill), (length - F.size(a)).cast("int")))


def pad_mask(a: Column, length: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), length.cast("int")), lambda i: i <= F.size(a))


def matmul(a: Column, rows: Column) -> Column:
    """``rows`` (array of arrays) times the vector ``a``."""
    return F.transform(rows, lambda r: dot(r, a))


def evenly_spaced(a: Column, n: int = 32) -> Column:
    """``n`` elements at positions spread evenly from first to last."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.element_at(a, (F.floor(i * (F.size(a) - 1) / F.lit(float(n - 1))) + 1).cast("int")),
    )


def inject(a: Column, code: Column, alpha: Column) -> Column:
    """``a + alpha * code``; alpha 0 gives ``a`` unchanged."""
    return F.when(alpha == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(
        F.zip_with(a, code, lambda x, y: x.cast("double") + alpha * y)
    )


def array_status(a: Column, width: int) -> Column:
    """Status of a vector cell: missing, empty, wrong width, not finite, or valid."""
    bad = F.exists(
        a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(math.inf))
    )
    return (
        F.when(a.isNull(), "MISSING")
        .when(F.size(a) == 0, "EMPTY")
        .when(F.size(a) != width, "WRONG_WIDTH")
        .when(bad, "NONFINITE")
        .otherwise("VALID")
    )


def sigmoid(x: Column) -> Column:
    """Logistic with the argument clipped to [-40, 40]."""
    return 1.0 / (1.0 + F.exp(-F.least(F.greatest(x, F.lit(-40.0)), F.lit(40.0))))


def softplus(x: Column, upper: float) -> Column:
    """ln(1 + e^x) limited to ``upper``; linear beyond 20 where both agree to double precision."""
    return F.least(F.when(x > 20, x).otherwise(F.log1p(F.exp(x))), F.lit(upper))
