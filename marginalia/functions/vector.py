"""Vector functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles, summed in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """A vector over its length; a zero vector stays."""
    return F.transform(a, lambda x: F.when(norm(a) > 0, x.cast("double") / norm(a)).otherwise(x.cast("double")))


def rounded(x: Column, places: int) -> Column:
    """Doubles rounded half away from zero; what rounds to nothing keeps its sign (-0.0), which ``round`` loses."""
    scaled = x * F.lit(10.0**places)
    return F.round(F.abs(scaled), 0) * F.signum(scaled) / F.lit(10.0**places)
