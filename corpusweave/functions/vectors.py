"""Column expressions over ``array<double>`` (or ``array<float>``) vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusweave.functions.text import let

NORM_FLOOR = 1e-12


def as_doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance; vectors of unequal length are an error."""
    summed = F.aggregate(
        F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: (x - y) * (x - y)),
        F.lit(0.0),
        lambda acc, term: acc + term,
    )
    return (
        F.when(F.size(a) == F.size(b), summed)
        .when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
        .otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))
    )


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(as_doubles(vector), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(vector: Column) -> Column:
    """Scale to unit length; a zero vector stays zero."""
    return let(
        vector,
        lambda v: let(
            F.greatest(l2_norm(v), F.lit(NORM_FLOOR)),
            lambda norm: F.transform(as_doubles(v), lambda x: x / norm),
        ),
    )


def rounded(vector: Column, digits: int = 6) -> Column:
    # + 0.0 turns a rounded -0.0 into 0.0.
    return F.transform(as_doubles(vector), lambda x: F.round(x, digits) + F.lit(0.0))
