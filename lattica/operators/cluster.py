"""Clustered covariance by inclusion and exclusion over subsets of the cluster dimensions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.prepare import subset_groups


def meats(scores: DataFrame, dims, columns) -> DataFrame:
    """Per subset of ``dims``: clusters and the sums of products of cluster score sums (``m0_0``, ``m0_1``, ...).

    ``scores`` has the dims and, per row, residual times regressor.  One job: the
    rows are summed by the finest clusters first, then by every subset.
    """
    groups = subset_groups(scores, dims, columns)
    products = [F.sum(F.col(a) * F.col(b)).alias(f"m{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]
    return groups.groupBy("dims").agg(F.count("*").alias("clusters"), *products)


def clustered_vcov(table: list, dims, k: int, bread: np.ndarray, n: int, nested: bool) -> tuple[np.ndarray, dict[str, int]]:
    """The covariance before repair, and the clusters of each single dimension."""
    total, singles = np.zeros((k, k)), {}
    for row in table:
        subset = row["dims"].split("*")
        if len(subset) == 1:
            singles[subset[0]] = row["clusters"]
        meat = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                meat[i, j] = meat[j, i] = row[f"m{i}_{j}"]
        total += (1 if len(subset) % 2 else -1) * (bread @ meat @ bread)
    least = min(singles.values())
    scale = max(1, n - 1) / max(1, n - k - nested)
    if least > 1:
        scale *= least / (least - 1)
    return total * scale, {d: singles[d] for d in dims}
