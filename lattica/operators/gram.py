"""Sums of products: group sums, moments, Gram matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.shipping import ship

#: Columns from which on one generated aggregate would be too long to compile.
WIDE = 24


def group_stats(df: DataFrame, dim: str, columns) -> DataFrame:
    """Per level of ``dim``: n and the sum and mean of each column (``sum_c``, ``mean_c``)."""
    sums = [a for c in columns for a in (F.sum(c).alias(f"sum_{c}"), F.avg(c).alias(f"mean_{c}"))]
    return df.groupBy(dim).agg(F.count("*").alias("n"), *sums)


def moments(df: DataFrame, columns) -> tuple[int, np.ndarray]:
    """Number of rows and means."""
    row = df.agg(F.count("*").alias("_n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return row[0], np.array([x or 0.0 for x in row[1:]], float)


def gram(df: DataFrame, columns) -> np.ndarray:
    """The symmetric matrix of sums of products.

    Up to WIDE columns it is one aggregate with partial sums in generated code;
    beyond, each batch becomes a partial matrix, and those are summed.
    """
    k = len(columns)
    out = np.zeros((k, k))
    if k <= WIDE:
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        row = df.agg(*[F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"g{i}_{j}") for i, j in pairs]).first()
        for (i, j), x in zip(pairs, row):
            out[i, j] = out[j, i] = x or 0.0
        return out

    ship(df.sparkSession)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            total += x.T @ x
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "x"])

    for i, j, x in df.select(*columns).mapInArrow(partial, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x")).collect():
        out[i, j] = out[j, i] = x
    return out
