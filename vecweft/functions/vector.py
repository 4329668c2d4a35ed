"""Distances and vector arithmetic, as Column expressions and as NumPy kernels.

Expressions add in double, left to right, so that they agree with the same sums in other engines. Spaces are ``l2``
(squared, no root), ``ip`` (1 - a.b) and ``cosine`` (``ip`` of normalised vectors).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = ("l2", "ip", "cosine")
#: Added to a norm before dividing, so that a zero vector stays zero.
TINY = 1e-30


def check_space(space: str) -> str:
    if space not in SPACES:
        raise ValueError(f"space must be one of {', '.join(SPACES)}, not {space!r}")
    return space


def _sum(products: Column) -> Column:
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def l2_squared(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def l2_bytes(a: Column, b: Column) -> Column:
    """Squared distance of integer components, in whole numbers."""
    products = F.zip_with(a, b, lambda x, y: (x.cast("long") - y.cast("long")) * (x.cast("long") - y.cast("long")))
    return F.aggregate(products, F.lit(0).cast("long"), lambda total, x: total + x)


def inner_product(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(inner_product(a, a))


def normalise(a: Column) -> Column:
    scale = 1.0 / (norm(a) + TINY)
    return F.transform(a, lambda x: x.cast("double") * scale)


def normalise_rows(a: Column) -> Column:
    """Divide by the norm, where a norm of 0 counts as 1."""
    size = F.when(norm(a) == 0.0, 1.0).otherwise(norm(a))
    return F.transform(a, lambda x: x.cast("double") / size)


def distance(a: Column, b: Column, space: str) -> Column:
    check_space(space)
    if space == "l2":
        return l2_squared(a, b)
    if space == "cosine":
        a, b = normalise(a), normalise(b)
    return F.lit(1.0) - inner_product(a, b)


def level_of(id_col: Column, m: int, seed: int = 100) -> Column:
    """Level of a node in a hierarchy: -ln(u) / ln(m), rounded down, with u in (0, 1] from a seeded hash of the id."""
    u = (F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1 << 53)) + 1) / F.lit(float(1 << 53))
    return F.floor(-F.log(u) / F.log(F.lit(float(m)))).cast("int")


def matrix(column) -> np.ndarray:
    """An Arrow column of arrays of one length as a matrix of doubles."""
    n = len(column)
    if not n:
        return np.empty((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) % n:
        raise ValueError("vectors differ in length")
    return flat.reshape(n, -1)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / (np.sqrt((rows * rows).sum(1, keepdims=True)) + TINY)


def distances(queries: np.ndarray, base: np.ndarray, space: str) -> np.ndarray:
    """All pairs by one matrix product; cosine expects normalised rows."""
    if not len(queries) or not len(base):
        return np.empty((len(queries), len(base)))
    dots = queries @ base.T
    if space != "l2":
        return 1.0 - dots
    return np.maximum((queries * queries).sum(1)[:, None] + (base * base).sum(1)[None, :] - 2.0 * dots, 0.0)


def one_by_one(a: np.ndarray, b: np.ndarray, space: str) -> np.ndarray:
    """Distances of the rows of a from the same rows of b, without cancellation."""
    return ((a - b) ** 2).sum(-1) if space == "l2" else 1.0 - (a * b).sum(-1)
