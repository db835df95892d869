"""Vector functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to this many dimensions a product is written out, so that it is compiled with its stage.
UNROLLED = 128


def dot(a: Column, b: Column, dim: int | None = None) -> Column:
    """Inner product in double precision; give ``dim`` where all vectors have it."""
    d = lambda v, i: F.get(v, F.lit(i)).cast("double")
    if dim and dim <= UNROLLED:
        return reduce(lambda s, i: s + d(a, i) * d(b, i), range(1, dim), d(a, 0) * d(b, 0))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column, dim: int | None = None) -> Column:
    return F.sqrt(dot(v, v, dim))


def l2_normalize(v: Column, dim: int | None = None) -> Column:
    """The vector over its length; a length below 1e-12 counts as that, so zero stays zero."""
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm(v, dim), F.lit(1e-12)))


def mean_pool(hidden: Column, mask: Column) -> Column:
    """Mean of the vectors whose mask is 1, for an array of vectors and an array of masks."""
    zero = F.transform(F.get(hidden, F.lit(0)), lambda _: F.lit(0.0))
    weighted = F.zip_with(hidden, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m))
    total = F.aggregate(weighted, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    count = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, m: s + m.cast("double")), F.lit(1e-9))
    return F.transform(total, lambda x: x / count)


def similarity(vector: Column, query: Column, length: Column, dim: int | None = None) -> Column:
    """Inner product with a query of length 1, over the stored length (at least 1e-9)."""
    return dot(vector, query, dim) / F.greatest(length, F.lit(1e-9))
