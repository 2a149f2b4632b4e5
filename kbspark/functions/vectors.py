"""Vector arithmetic as Spark column expressions (O-65, O-66, O-73).

Spark 4.1 has no native vector functions, so the arithmetic is written with the array
higher-order functions (``zip_with`` + ``aggregate``), which run JVM-side without any Python.
Vectors are cast to ``array<double>`` before summation. To keep the per-pair work to a single
dot product, callers normalise each stored vector once (``unit``) and compare unit vectors.
Distances are rounded to ``DIST_DIGITS`` so that ranking is stable across engines.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from kbspark.functions.exprs import let

DIST_DIGITS = 9


def _d(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_d(a), F.lit(0.0), lambda acc, x: acc + x * x))


def unit(a) -> Column:
    """``a / |a|``; a zero vector stays all zeros (its cosine distance is defined as 1.0)."""
    return let(_d(a), lambda v: let(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))))


def cosine_distance_unit(u, v) -> Column:
    """Cosine distance of two already-normalised vectors; a zero vector gives 1.0."""
    d = dot(u, v)
    zero = (F.aggregate(_d(u), F.lit(0.0), lambda acc, x: acc + x * x) == 0) | \
           (F.aggregate(_d(v), F.lit(0.0), lambda acc, x: acc + x * x) == 0)
    return F.round(F.when(zero, F.lit(1.0)).otherwise(F.lit(1.0) - d), DIST_DIGITS)


def cosine_distance(a, b) -> Column:
    """``1 - a·b / (|a||b|)``, zero norm → 1.0, NULL when the lengths differ."""
    na, nb = norm(a), norm(b)
    same_len = F.size(_d(a)) == F.size(_d(b))
    raw = F.when((na == 0) | (nb == 0), F.lit(1.0)).otherwise(F.lit(1.0) - dot(a, b) / (na * nb))
    return F.when(same_len, F.round(raw, DIST_DIGITS))


def l2_distance(a, b) -> Column:
    """Euclidean distance, NULL when the lengths differ."""
    sq = F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(_d(a)) == F.size(_d(b)), F.round(F.sqrt(sq), DIST_DIGITS))
