"""Rows and columns before estimation: pruning, missing values, dense ids, group sizes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _missing(df: DataFrame, column: str) -> Column:
    c = F.col(column)
    return c.isNull() | F.isnan(c) if df.schema[column].dataType.typeName() in ("double", "float") else c.isNull()


def prune(df: DataFrame, columns) -> DataFrame:
    """The columns, each once; the projection reaches the scan."""
    return df.select(*dict.fromkeys(columns))


def drop_missing(df: DataFrame, columns=None) -> DataFrame:
    """Rows without null or NaN in any of the columns."""
    return df.where(~reduce(lambda a, b: a | b, [_missing(df, c) for c in columns or df.columns]))


def reject_missing(df: DataFrame, columns=None) -> int:
    """Number of rows; raises if there are none, or if one has a null or NaN."""
    bad = reduce(lambda a, b: a | b, [_missing(df, c) for c in columns or df.columns])
    n, wrong = df.agg(F.count("*"), F.count_if(bad)).first()
    if wrong:
        raise ValueError(f"{wrong} rows have missing values; drop them first")
    if not n:
        raise ValueError("no observations remain")
    return n


def group_sizes(df: DataFrame, dims) -> dict[str, int]:
    """Levels of each dimension, in one pass."""
    row = df.agg(*[F.count_distinct(d).alias(f"g{i}") for i, d in enumerate(dims)]).first() if dims else ()
    return dict(zip(dims, row))


def dense_ids(df: DataFrame, column: str, name: str = "level_id") -> DataFrame:
    """(column, id): the distinct values in order, numbered from 1.

    Values are sorted by range, numbered within each range, and shifted by the
    sizes of the ranges before, so no task sees all of them.
    """
    ranged = df.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(column).sortWithinPartitions(column)
    numbered = ranged.withColumn("_id", F.monotonically_increasing_id())
    numbered = numbered.select(column, F.shiftright("_id", 33).alias("_range"), (F.col("_id") % (1 << 33)).alias("_place"))
    sizes = numbered.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    return numbered.join(shifts, "_range").select(column, (F.col("_shift") + F.col("_place") + 1).cast("int").alias(name))


def composite_clusters(df: DataFrame, dims) -> DataFrame:
    """Number of distinct combinations of every non-empty subset of ``dims``: (dims, clusters)."""
    return subset_groups(df.select(*dims).distinct(), dims, []).groupBy("dims").agg(F.count("*").alias("clusters"))


def subset_groups(df: DataFrame, dims, sums) -> DataFrame:
    """Groups of every non-empty subset of ``dims`` with sums of columns: (dims, the keys, the sums).

    ``dims`` joins the names of the subset by ``*``.  Rows are first grouped by all
    dims, so the expansion over subsets multiplies groups, not rows.
    """
    from itertools import combinations

    subsets = [s for k in range(len(dims), 0, -1) for s in combinations(dims, k)]
    fine = df.groupBy(*dims).agg(*[F.sum(c).alias(c) for c in sums]) if sums else df.select(*dims).distinct()
    absent = [F.grouping(d).alias(f"_no{i}") for i, d in enumerate(dims)]
    totals = [F.sum(c).alias(c) for c in sums] or [F.count("*").alias("_n")]
    cubed = fine.groupingSets([[F.col(c) for c in s] for s in subsets], *dims).agg(*absent, *totals)
    named = F.concat_ws("*", *[F.when(F.col(f"_no{i}") == 0, F.lit(d)) for i, d in enumerate(dims)])
    return cubed.withColumn("dims", named).drop(*[f"_no{i}" for i in range(len(dims))], "_n")
