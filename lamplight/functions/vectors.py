"""Vector arithmetic on array and map columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: below this length a vector is left as it is.
TINY_NORM = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda total, x: total + x,
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (norm(a) * norm(b))


def sparse_dot(a: Column, b: Column) -> Column:
    """Inner product of two token-to-weight maps."""
    shared = F.map_filter(a, lambda k, _: F.map_contains_key(b, k))
    return F.aggregate(
        F.map_entries(shared),
        F.lit(0.0),
        lambda total, e: total + e["value"].cast("double") * F.element_at(b, e["key"]).cast("double"),
    )


def blend(original: Column, feedback: Column, beta: float) -> Column:
    return F.zip_with(
        original, feedback, lambda q, c: q.cast("double") * (1.0 - beta) + c.cast("double") * beta
    )


def unit(vector: Column) -> Column:
    length = norm(vector)
    return F.when(length < TINY_NORM, F.transform(vector, lambda x: x.cast("float"))).otherwise(
        F.transform(vector, lambda x: (x / length).cast("float"))
    )


def int_keys(weights: Column) -> Column:
    """Token ids that arrive as text become integers."""
    return F.transform_keys(weights, lambda k, _: k.cast("int"))


def has_dimension(vector: Column, dimension: int) -> Column:
    return F.size(vector) == dimension


def sparse_fits(weights: Column, dimension: int) -> Column:
    return F.forall(F.map_keys(weights), lambda k: (k >= 0) & (k < dimension))
