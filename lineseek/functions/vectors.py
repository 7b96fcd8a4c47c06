"""Vector expressions over ``ARRAY<FLOAT>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lineseek.session import let


def zero_vector(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), dim)


def dot_product(a: Column, b: Column) -> Column:
    """Sum of products of two vectors of one length, in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two vectors cut to the shorter length; 0 if either norm is 0 or null."""
    common = F.least(F.size(a), F.size(b))

    def of_cut(pair: Column) -> Column:
        left, right = pair["left"], pair["right"]
        norms = F.sqrt(dot_product(left, left)) * F.sqrt(dot_product(right, right))
        return F.when(norms > 0, dot_product(left, right) / norms).otherwise(0.0)

    cut = F.struct(
        F.slice(a, F.lit(1), common).alias("left"), F.slice(b, F.lit(1), common).alias("right")
    )
    return F.when(a.isNotNull() & b.isNotNull(), let(cut, of_cut)).otherwise(0.0)
