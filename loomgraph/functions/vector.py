"""Vector arithmetic as Column expressions, evaluated in double precision on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Norms up to this count as zero.
TINY = 1e-10

COSINE, EUCLIDEAN, DOT = "cosine", "euclidean", "dot"


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def squared_euclidean(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(doubles(v), lambda x: x * x)))


def normalize(v: Column) -> Column:
    """v over its norm; vectors with a norm of TINY or less stay as they are."""
    n = norm(v)
    return F.when(n > TINY, F.transform(doubles(v), lambda x: x / n)).otherwise(doubles(v))


def is_normalized(v: Column, tolerance: float = 1e-5) -> Column:
    return F.abs(norm(v) - 1.0) < tolerance


def cosine_similarity(a: Column, b: Column) -> Column:
    """The dot product: both sides are expected to be normalised."""
    return dot(a, b)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1.0 - dot(a, b)


def distance(metric: str, a: Column, b: Column) -> Column:
    if metric == COSINE:
        return cosine_distance(a, b)
    if metric == EUCLIDEAN:
        return euclidean(a, b)
    if metric == DOT:
        return -dot(a, b)
    raise ValueError(f"unknown metric {metric!r}")


def similarity(metric: str, d: Column) -> Column:
    """What a distance means as similarity."""
    if metric == COSINE:
        return 1.0 - d
    if metric == EUCLIDEAN:
        return 1.0 / (1.0 + d)
    if metric == DOT:
        return -d
    raise ValueError(f"unknown metric {metric!r}")


def dot_at(rows: Column, width: int, place: Column, query: Column) -> Column:
    """Dot product of query with the place-th (from 0) vector of a flat array of rows."""
    return dot(F.slice(rows, place * width + 1, F.lit(width)), query)


def squared_euclidean_at(rows: Column, width: int, place: Column, query: Column) -> Column:
    return squared_euclidean(F.slice(rows, place * width + 1, F.lit(width)), query)


def is_finite(v: Column) -> Column:
    return F.forall(doubles(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def is_valid(v: Column, dimensions: int | None = None) -> Column:
    """Finite, not all zero and (if given) of the right length: what may be stored."""
    fine = v.isNotNull() & is_finite(v) & F.exists(doubles(v), lambda x: x != 0)
    return fine & (F.size(v) == dimensions) if dimensions is not None else fine


def adc_distance(table: Column, codes: Column, centroids: int) -> Column:
    """Sum of a query's table entries (subspaces times centroids, flat) at the codes."""
    return F.aggregate(
        F.transform(codes, lambda c, m: F.element_at(table, (m * centroids + c + 1).cast("int"))), F.lit(0.0), lambda a, x: a + x
    )
