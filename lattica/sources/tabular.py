"""CSV, Parquet and pickle tables, read with only the columns that are needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def guess_format(path: str) -> str:
    name = path.lower()
    for ends, kind in (((".parquet", ".pq"), "parquet"), ((".csv", ".csv.gz", ".txt"), "csv"), ((".pkl", ".pickle"), "pickle")):
        if name.endswith(ends):
            return kind
    raise ValueError(f"can't tell the format of {path}")


def read_table(spark: SparkSession, path: str, kind: str = "auto", columns=None) -> DataFrame:
    """``kind`` is auto (by suffix), csv, parquet or pickle.  A pickled frame is read by the driver; only load trusted files."""
    kind = guess_format(path) if kind == "auto" else kind
    if kind == "parquet":
        df = spark.read.parquet(path)
    elif kind == "csv":
        df = spark.read.csv(path, header=True, inferSchema=True)
    elif kind == "pickle":
        import pandas as pd

        df = spark.createDataFrame(pd.read_pickle(path))
    else:
        raise ValueError(f"unknown format {kind!r}")
    return df.select(*dict.fromkeys(columns)) if columns else df


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
