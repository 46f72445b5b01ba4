"""Small systems of linear equations as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def solved(matrix: Column, k: int, least: float = 0.0) -> Column:
    """Solution of k equations, an array of rows of k coefficients and the right side, by elimination in order; null where a pivot is ``least`` or smaller."""
    def cleared(m: Column, i: Column) -> Column:
        """Column i is zero but in row i."""
        pivot = F.element_at(m, i)
        size = F.element_at(pivot, i)
        return F.transform(m, lambda row, r: F.when(r + 1 == i, row).otherwise(
            F.zip_with(row, pivot, lambda a, b: a - F.element_at(row, i) / F.when(F.abs(size) > least, size) * b)))

    done = F.reduce(F.sequence(F.lit(1), F.lit(k)), matrix, cleared)
    x = F.transform(done, lambda row, r: F.element_at(row, k + 1) / F.when(F.abs(F.get(row, r)) > least, F.get(row, r)))
    return F.when(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c)), x)


def eliminated(m: np.ndarray, least: float = 0.0) -> np.ndarray:
    """Solutions of many systems (systems, k, k + 1), step by step as in ``solved``; not a number where a pivot is ``least`` or smaller."""
    k = m.shape[1]
    with np.errstate(all="ignore"):
        for i in range(k):
            size = np.where(np.abs(m[:, i, i]) > least, m[:, i, i], np.nan)
            others = np.arange(k) != i
            m[:, others] -= (m[:, others, i] / size[:, None])[:, :, None] * m[:, i, None, :]
        size = np.diagonal(m, axis1=1, axis2=2)
        return m[:, :, k] / np.where(np.abs(size) > least, size, np.nan)


def solved_in_batches(matrix: Column, k: int) -> Column:
    """``solved`` for many large systems: the same steps for all systems of an Arrow batch at once."""

    @F.arrow_udf("array<double>")
    def solve(flat: pa.Array) -> pa.Array:
        there = flat.is_valid().to_numpy(zero_copy_only=False)
        m, x = flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, k, k + 1), np.full((len(flat), k), np.nan)
        at = np.flatnonzero(there)
        for lo in range(0, len(at), 1_000):
            x[at[lo:lo + 1_000]] = eliminated(m[lo:lo + 1_000].astype(np.float64))
        none = np.isnan(x).any(axis=1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), pa.array(x.ravel()), mask=pa.array(none))

    return solve(F.flatten(matrix))


def products(terms: Sequence[Column], target: Column) -> Column:
    """Aggregate: the normal equations of ``target`` on the terms, an array of rows."""
    k = len(terms)
    sums = {(i, j): F.sum(terms[i] * terms[j]) for i in range(k) for j in range(i, k)}
    return F.array(*[F.array(*[sums[min(i, j), max(i, j)] for j in range(k)], F.sum(terms[i] * target)) for i in range(k)])


def scaled(matrix: str, k: int, least: float = 1e-12) -> Column:
    """Solution of normal equations: terms are brought to length one first, so that ``least`` tells dependent terms whatever their units."""
    m, size = F.col(matrix), lambda i: F.sqrt(F.get(F.get(matrix, i), i))
    even = F.transform(m, lambda row, r: F.transform(row, lambda v, c: F.try_divide(v, size(r) * F.when(c < k, size(c)).otherwise(1.0))))
    return F.transform(solved(even, k, least), lambda x, i: x / size(i))
