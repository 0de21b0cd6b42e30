"""Vector arithmetic on ``array<float>`` columns, in double precision."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from reelgraph.functions.hof import bind


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def _clip(value: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in [-1, 1]; 0 when the lengths differ or a norm is 0."""
    value = bind(norm(a) * norm(b), lambda n: F.when(n == 0, F.lit(0.0)).otherwise(_clip(dot(a, b) / n)))
    return F.when(F.size(a) != F.size(b), F.lit(0.0)).otherwise(F.coalesce(value, F.lit(0.0)))


def euclidean(a: Column, b: Column) -> Column:
    """L2 distance; infinite when the lengths differ."""
    squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    value = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))
    return F.when(F.size(a) != F.size(b), F.lit(math.inf)).otherwise(F.coalesce(value, F.lit(math.inf)))


def l2_normalize(a: Column) -> Column:
    return bind(norm(a), lambda n: F.when(n == 0, a.cast("array<double>")).otherwise(
        F.transform(a, lambda x: x.cast("double") / n)
    ))


def mean_vector(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x.cast("double") + y.cast("double")) / 2)


def resample(a: Column, size: Column) -> Column:
    """``a`` read at ``size`` evenly spaced places from 0 to its length, linearly between elements.

    Places past the last element take the last element.
    """
    n = F.size(a)
    step = n.cast("double") / (size - 1)

    def at(i: Column) -> Column:
        place = i * step
        left = F.least(F.floor(place).cast("int"), n - 1)
        right = F.least(left + 1, n - 1)
        share = F.least(place, (n - 1).cast("double")) - left
        low = F.get(a, left).cast("double")
        return low + (F.get(a, right).cast("double") - low) * share

    return F.when(size == 1, F.array(F.get(a, F.lit(0)).cast("double"))).otherwise(
        F.transform(F.sequence(F.lit(0), size - 1), at)
    )


def fuse_chunk_embedding(text_vector: Column, visual_vector: Column) -> Column:
    """Unit mean of the two vectors, the visual one resampled to the text length; null if neither exists."""
    sized = F.when(F.size(visual_vector) == F.size(text_vector), visual_vector.cast("array<double>")).otherwise(
        resample(visual_vector, F.size(text_vector))
    )
    combined = (
        F.when(text_vector.isNotNull() & visual_vector.isNotNull(), mean_vector(text_vector, sized))
        .when(text_vector.isNotNull(), text_vector.cast("array<double>"))
        .otherwise(visual_vector.cast("array<double>"))
    )
    return F.when(combined.isNotNull(), l2_normalize(combined))
