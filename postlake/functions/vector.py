"""Vector expressions over array columns, in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def literal(vector: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_distance(a, b) -> Column:
    """1 - cosine; null for a null, zero or differently long vector."""
    scale = norm(a) * norm(b)
    return F.when((scale > 0) & (F.size(_c(a)) == F.size(_c(b))), 1 - dot(a, b) / scale)


def literal_cosine_distance(column, vector: Sequence[float]) -> Column:
    """Distance to a fixed vector: its norm is computed once, on the driver."""
    size = sum(float(x) ** 2 for x in vector) ** 0.5
    if not size:
        return F.lit(None).cast("double")
    scale = norm(column) * F.lit(size)
    return F.when((scale > 0) & (F.size(_c(column)) == F.lit(len(vector))), 1 - dot(column, literal(vector)) / scale)


def similarity(distance) -> Column:
    return 1 - _c(distance)


def sign_bucket(vector, planes: Sequence[Sequence[float]]) -> Column:
    """Locality-sensitive bucket: one bit a plane, by the side that the vector lies on."""
    bits = [F.when(dot(vector, literal(p)) >= 0, F.lit(1 << i)).otherwise(F.lit(0)) for i, p in enumerate(planes)]
    out = bits[0]
    for b in bits[1:]:
        out = out + b
    return out
