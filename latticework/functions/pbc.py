"""Vector arithmetic in an orthorhombic periodic box; a null box length means no period."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(prefix: str, names: str = "xyz") -> Vec:
    return tuple(F.col(f"{prefix}{n}") for n in names)


def minimum_image(d: Column, length: Column) -> Column:
    """Nearest image of a displacement; ties go to the even multiple."""
    return F.when(length.isNull(), d).otherwise(d - length * F.rint(d / length))


def delta(a: Vec, b: Vec, box: Vec) -> Vec:
    """Minimum image of b - a."""
    return tuple(minimum_image(q - p, n) for p, q, n in zip(a, b, box, strict=True))


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def scale(a: Vec, k: Column | float) -> Vec:
    return tuple(x * k for x in a)
