"""Similarity of two vector columns as expressions, for pairs that are already joined."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot_score(a: Column, b: Column) -> Column:
    """Dot product accumulated in DOUBLE."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot_score(a, a))


def cos_sim(a: Column, b: Column) -> Column:
    """Cosine; a zero vector scores 0."""
    return F.coalesce(F.try_divide(dot_score(a, b), norm(a) * norm(b)), F.lit(0.0))


# Score functions by name; pass an extended copy to plug in others.
SCORE_EXPRESSIONS = {"cos_sim": cos_sim, "dot_score": dot_score}
