"""Column functions on arrays of doubles, and their way to numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions.let import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(a: Column) -> Column:
    """At length one; a zero vector stays zero."""
    return let(a, lambda v: let(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def sums(coef: Column, vec: Column, dim: int) -> list[Column]:
    """Aggregates whose values are the elements of the sum of coef * vec: no element becomes a row of its own, and
    partial sums are made before the shuffle."""
    return [F.coalesce(F.sum(coef * F.get(vec, F.lit(i))), F.lit(0.0)).alias(f"_{i}") for i in range(dim)]


def packed(dim: int) -> Column:
    return F.array(*[F.col(f"_{i}") for i in range(dim)])


def matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """The rows of a list column without nulls, as float64."""
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(lists), dim)
