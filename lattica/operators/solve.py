"""Dense algebra on the driver: normal equations, least squares, covariance repair.  All matrices are K x K."""

from __future__ import annotations

import numpy as np

NO_VARIANCE = 1e-10


def with_variance(q: np.ndarray) -> list[int]:
    """Columns whose diagonal entry isn't negligible against the largest."""
    diagonal = np.abs(np.diag(q))
    return [i for i, x in enumerate(diagonal) if x > NO_VARIANCE * max(1.0, diagonal.max(initial=0.0))]


def solve(q: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Solution and inverse of a positive definite system by Cholesky; None if it isn't one."""
    try:
        half = np.linalg.cholesky(q)
    except np.linalg.LinAlgError:
        return None
    inverse_half = np.linalg.solve(half, np.eye(len(q)))
    inverse = inverse_half.T @ inverse_half
    return inverse @ b, inverse


def two_stage(g: np.ndarray, y: int, x: list[int], star: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Q, b and the projection P (regressors are projected to Z* P), from one matrix of products; None if Z*'Z* is singular."""
    zz, zx, zy = g[np.ix_(star, star)], g[np.ix_(star, x)], g[np.ix_(star, [y])][:, 0]
    done = solve(zz, zy)
    if done is None:
        return None
    projection = done[1] @ zx
    q = zx.T @ projection
    return (q + q.T) / 2, projection.T @ zy, projection


def clip_negative(v: np.ndarray) -> np.ndarray:
    """The nearest matrix without negative eigenvalues."""
    v = (v + v.T) / 2
    values, vectors = np.linalg.eigh(v)
    return v if values.min(initial=0.0) >= 0 else (vectors * np.maximum(values, 0.0)) @ vectors.T
