"""Vector arithmetic as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalise(vector: Column) -> Column:
    """The vector at length 1, as doubles; a zero vector stays as it is."""
    scaled = F.transform(F.array(l2_norm(vector)), lambda n: F.when(n > 0, F.transform(vector, lambda x: x.cast("double") / n)).otherwise(vector.cast("array<double>")))
    return F.element_at(scaled, 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
