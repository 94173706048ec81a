"""A balanced worker-firm-time panel with known coefficients."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PanelOptions:
    """Sizes, coefficients and standard deviations."""

    workers: int = 1000
    firms: int = 200
    periods: int = 8
    intercept: float = 1.0
    betas: tuple[float, float] = (0.4, -0.2)
    extra_vars: int = 0
    extra_coeffs: tuple[float, ...] = ()
    extra_std: float = 0.3
    noise_std: float = 0.5
    sick_std: float = 0.5
    iv_vars: int = 0
    iv_noise_std: float = 0.25
    endog_cols: tuple[int, ...] = ()
    seed: int = 1234


def run_counter(df: DataFrame, who: str, when: str, what: str, name: str = "tenure") -> DataFrame:
    """How many rows in a row ``who`` has had the same ``what`` before this one, by ``when``."""
    in_time = Window.partitionBy(who).orderBy(when)
    change = F.coalesce((F.col(what) != F.lag(what).over(in_time)).cast("int"), F.lit(1))
    runs = df.withColumn("_run", F.sum(change).over(in_time))
    place = F.row_number().over(Window.partitionBy(who, "_run").orderBy(when)) - 1
    return runs.withColumn(name, place.cast("double")).drop("_run")


def _uniform(seed: int, *keys) -> Column:
    """A number in (0, 1) that depends on the seed and the keys only, whatever the partitioning."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) + 0.5) / float(1 << 53)


def _normal(std: float, seed: int, *keys) -> Column:
    radius = F.sqrt(-2.0 * F.log(_uniform(2 * seed, *keys)))
    return std * radius * F.cos(6.283185307179586 * _uniform(2 * seed + 1, *keys))


def build_panel(spark: SparkSession, options: PanelOptions | None = None) -> DataFrame:
    """worker, firm, time, tenure, sick_shock, wage, extra_j, iv_j."""
    o = options or PanelOptions()
    if o.extra_coeffs and len(o.extra_coeffs) != o.extra_vars:
        raise ValueError("there must be one coefficient per extra variable")
    coefficients = o.extra_coeffs or tuple(round(0.5 * ((-1) ** j) / (1 + j), 4) for j in range(o.extra_vars))
    cells = spark.range(o.workers * o.periods).select((F.floor(F.col("id") / o.periods) + 1).cast("int").alias("worker"), (F.col("id") % o.periods + 1).cast("int").alias("time"))
    cells = cells.withColumn("firm", (F.floor(_uniform(o.seed, F.lit("firm"), "worker", "time") * o.firms) + 1).cast("int"))
    cells = run_counter(cells, "worker", "time", "firm")
    at = ("worker", "time")
    draw = lambda std, label, *keys: _normal(std, o.seed, F.lit(label), *keys)
    cells = cells.withColumn("sick_shock", draw(o.sick_std, "sick", *at))
    for j in range(o.extra_vars):
        cells = cells.withColumn(f"extra_{j + 1}", draw(o.extra_std, f"extra{j}", *at) + 0.02 * (F.col("time") - 1))
    wage = o.intercept + o.betas[0] * F.col("tenure") + o.betas[1] * F.col("sick_shock")
    for j, c in enumerate(coefficients):
        wage = wage + c * F.col(f"extra_{j + 1}")
    wage = wage + draw(0.3, "worker", "worker") + draw(0.2, "firm", "firm") + draw(0.1, "time", "time") + draw(o.noise_std, "noise", *at)
    cells = cells.withColumn("wage", wage)
    base = ["tenure", "sick_shock", *[f"extra_{j + 1}" for j in range(o.extra_vars)]]
    sources = [base[max(1, min(len(base), c)) - 1] for c in o.endog_cols] or base
    for j in range(o.iv_vars):
        noise = draw(o.iv_noise_std, f"iv{j}", *at) + draw(0.1, f"iv{j}b", *at)
        cells = cells.withColumn(f"iv_{j + 1}", F.col(sources[j % len(sources)]) + noise)
    order = ["worker", "firm", "time", "tenure", "sick_shock", "wage", *base[2:], *[f"iv_{j + 1}" for j in range(o.iv_vars)]]
    return cells.select(*order)
