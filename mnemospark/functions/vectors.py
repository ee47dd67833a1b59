"""Column functions over array vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def cosine(a: Column, vector: list[float]) -> Column:
    """Cosine with a literal vector; 0 if lengths differ, a value is empty, or a norm is 0."""
    norm = math.sqrt(sum(float(x) ** 2 for x in vector))
    own = F.sqrt(dot(a, a))
    return F.when((F.size(a) == len(vector)) & (own > 0) & F.lit(norm > 0), dot(a, literal(vector)) / (own * F.lit(norm))).otherwise(F.lit(0.0))
