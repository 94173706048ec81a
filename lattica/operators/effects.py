"""Recovered fixed-effect values, and their CSV form."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.prepare import dense_ids
from lattica.operators.within import Absorbed


def recover(absorbed: Absorbed, beta: np.ndarray) -> dict[str, DataFrame]:
    """Per dimension (level, fe_value, n): the effects of y less those of the regressors, centred by observations.

    Effects are linear in the column, so nothing is solved again; the grand mean
    stays out of every dimension.
    """
    out = {}
    for d, table in absorbed.effects.items():
        value = F.col("a0")
        for i, b in enumerate(beta, 1):
            value = value - F.lit(float(b)) * F.col(f"a{i}")
        values = table.select(F.col(d).alias("level"), value.alias("v"), "n")
        centre = values.agg(F.sum(F.col("v") * F.col("n")) / F.sum("n")).first()[0]
        out[d] = values.select("level", (F.col("v") - F.lit(float(centre or 0.0))).alias("fe_value"), "n")
    return out


def write_csv(effects: dict[str, DataFrame], prefix: str) -> list[str]:
    """``<prefix>_fe<d>.csv`` per dimension: level_id (1 for the first level in order), fe_value with 17 digits.

    One file per dimension is the format, so rows come to the driver one partition at a time, in order.
    """
    paths = []
    os.makedirs(os.path.dirname(os.path.abspath(prefix)), exist_ok=True)
    for number, table in enumerate(effects.values(), 1):
        path = f"{prefix}_fe{number}.csv"
        rows = table.join(dense_ids(table, "level"), "level").select("level_id", "fe_value").orderBy("level_id")
        with open(path, "w") as out:
            out.write("level_id,fe_value\n")
            for level, value in rows.toLocalIterator(prefetchPartitions=True):
                out.write(f"{level},{value:.16E}\n")
        paths.append(path)
    return paths
