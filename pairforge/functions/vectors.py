"""Vector expressions over ``array<float>``, accumulated in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda total, x: total + x,
    )


def norm(a: Column) -> Column:
    return F.sqrt(
        F.aggregate(
            a, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")
        )
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; a zero vector scores 0."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(EPSILON)) * F.greatest(norm(b), F.lit(EPSILON)))


def unit_cosine(a: Column, b: Column) -> Column:
    """Cosine moved to 0..1; this is the score the semantic threshold is about."""
    return (cosine(a, b) + 1.0) / 2.0


def paired_cosine_similarity(a: Column, b: Column) -> Column:
    """One minus half the squared distance of the unit vectors.

    Equal to the cosine for non-zero vectors; one zero vector gives 0.5 and two give 1.
    Written through the norms so that each vector is read twice only.
    """
    na, nb = norm(a), norm(b)
    return (
        F.when((na > 0) & (nb > 0), dot(a, b) / (na * nb))
        .when((na > 0) | (nb > 0), F.lit(0.5))
        .when(na.isNotNull() & nb.isNotNull(), F.lit(1.0))
    )


def mean_pool(token_vectors: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is set; zeros when none is.

    ``token_vectors`` is ``array<array<float>>`` and ``mask`` holds 0 or 1 per token.
    """
    masked = F.zip_with(
        token_vectors, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m)
    )
    zeros = F.transform(F.get(token_vectors, F.lit(0)), lambda _: F.lit(0.0))
    total = F.aggregate(masked, zeros, lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y))
    kept = F.aggregate(mask, F.lit(0.0), lambda acc, m: acc + m)
    return F.transform(total, lambda x: x / F.greatest(kept, F.lit(1e-9)))
