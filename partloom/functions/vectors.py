"""Vector expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum_of_products(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    """Dot product; 0.0 when a side is missing or the sizes differ."""
    return F.when(F.size(a) == F.size(b), F.coalesce(_sum_of_products(a, b), F.lit(0.0))).otherwise(F.lit(0.0))


def norm(a: Column) -> Column:
    return F.sqrt(_sum_of_products(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null when a norm is 0 or the sizes differ."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), _sum_of_products(a, b) / size)


def similarity_percent(similarity: Column) -> Column:
    return F.round(similarity * 100, 2)


def stand_in_embedding(text: Column, dims: int = 64) -> Column:
    """Deterministic vector of a text for runs without an embedding provider.

    Every dimension is a hex digit of a sha256 of the text, scaled to [-1, 1]; 64 digits per hash.
    """
    blocks = [
        F.sha2(F.concat(text, F.lit(f"#{block}")), 256) for block in range((dims + 63) // 64)
    ]
    digits = F.split(F.substring(F.concat(*blocks), 1, dims), "")
    return F.transform(
        digits, lambda x: ((F.instr(F.lit("0123456789abcdef"), x) - F.lit(8.5)) / F.lit(7.5)).cast("float")
    )
