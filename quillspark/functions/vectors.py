"""Vector expressions over array columns, in double precision, left to right."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_l2(a: Column, b: Column) -> Column:
    """Squared distance; of vectors of different sizes, over the dimensions both have."""
    both = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(F.filter(both, lambda d: d.isNotNull()), F.lit(0.0), lambda s, d: s + d)


def cosine(d2: Column) -> Column:
    """The cosine of two unit vectors from their squared distance."""
    return 1 - d2 / 2


def normalized(v: Column) -> Column:
    """`v` at unit length; a zero vector stays."""
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(size > 0, F.transform(v, lambda x: x.cast("double") / size)).otherwise(F.transform(v, lambda x: x.cast("double")))


def strength(z: Column) -> Column:
    """Strong from 2.52, clear from 1.96, else near; null where there is no z."""
    return F.when(z >= 2.52, "strong").when(z >= 1.96, "clear").when(z.isNotNull(), "near")
