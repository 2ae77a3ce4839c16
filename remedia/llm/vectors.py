"""Vectors of whole numbers: conversion, choice of an exact number type, squared distances."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components are held within this bound on either side; a 64-bit column can't hold more.
LIMIT = 2**62
LONG_MAX = 2**63 - 1


def is_finite(name: str) -> Column:
    """Whether a vector is there and holds finite numbers only."""
    def good(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))

    return F.coalesce(F.col(name).isNotNull() & F.forall(name, good), F.lit(False))


def whole(name: str, factor: int) -> Column:
    """``floor(factor * x)`` of every component, held within ``LIMIT``."""
    return F.transform(name, lambda x: F.greatest(F.lit(-LIMIT), F.least(
        F.lit(LIMIT), F.floor(F.lit(float(factor)) * x.cast("double")))))


def number_type(bound: int, dim: int) -> type:
    """Doubles, 64-bit integers or Python integers: the first in which squared distances are exact."""
    most = 4 * dim * int(bound) ** 2
    return np.float64 if most < 2**53 else np.int64 if most < 2**63 else object


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of ``dim`` integers as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def largest(values: np.ndarray) -> int:
    return max(abs(int(values.min())), abs(int(values.max()))) if values.size else 0


def squared(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all points, exact in the number type of both."""
    if rows.dtype == np.float64:
        return (rows * rows).sum(1)[:, None] - 2.0 * (rows @ points.T) + (points * points).sum(1)
    out = np.empty((len(rows), len(points)), rows.dtype)
    for i, point in enumerate(points):
        out[:, i] = ((rows - point) ** 2).sum(1)
    return out


def add_up(rows: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Sums of the rows of each group, exact."""
    if rows.dtype == np.float64:  # a batch of components below 2**24 stays below 2**53
        return np.stack([np.bincount(group, weights=c, minlength=groups) for c in rows.T], 1).astype(np.int64)
    out = np.zeros((groups, rows.shape[1]), rows.dtype)
    np.add.at(out, group, rows)
    return out


def as_longs(values: np.ndarray) -> pa.Array:
    """Distances as 64-bit integers; those beyond are held at the largest."""
    if values.dtype == object:
        return pa.array([min(int(v), LONG_MAX) for v in values], pa.int64())
    return pa.array(values.astype(np.int64))


def decimals(values: Iterable[int]) -> pa.Array:
    return pa.array([int(v) for v in values], pa.decimal128(38, 0))


def long_sum(name: str) -> Column:
    """The sum of a column of longs, held at the largest long."""
    total = F.sum(F.col(name).cast("decimal(38,0)"))
    return F.least(total, F.lit(LONG_MAX).cast("decimal(38,0)")).cast("long")


def mean_floors(sums: DataFrame, *by: str) -> dict[tuple, list[int]]:
    """Componentwise ``floor(sum / n)`` of each group of ``by..., n, sums``.

    Tasks send one row a group, and the driver gets the components of one vector a group:
    callers group by entries of a model, whose number is a parameter.
    """
    each = sums.select(*by, "n", F.posexplode("sums").alias("i", "x")).groupBy(*by, "i").agg(
        F.sum("x").alias("x"), F.sum("n").alias("n")).collect()
    out: dict[tuple, list[int]] = {}
    for r in sorted(each, key=lambda r: r["i"]):
        out.setdefault(tuple(r[b] for b in by), []).append(int(r["x"]) // int(r["n"]))
    return out


def digest(numbers: Iterable[Sequence[int]]) -> str:
    """SHA-256 of integers in decimal, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for row in numbers for x in row).encode()).hexdigest()
