"""Vector expressions over ``ARRAY<FLOAT>`` columns, computed in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def _product(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))


def dot(left: Column, right: Column) -> Column:
    return _total(_product(left, right))


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def squared_l2(left: Column, right: Column) -> Column:
    return _total(
        F.zip_with(left, right, lambda a, b: F.pow(a.cast("double") - b.cast("double"), F.lit(2.0)))
    )


def cosine(left: Column, right: Column) -> Column:
    """Cosine similarity; a zero vector scores 0."""
    scale = norm(left) * norm(right)
    return F.when(scale > 0, dot(left, right) / scale).otherwise(F.lit(0.0))


def has_dimension(vector: Column, dim: int) -> Column:
    return F.coalesce(F.size(vector) == dim, F.lit(False)) & F.coalesce(
        F.forall(vector, lambda v: v.isNotNull()), F.lit(False)
    )
