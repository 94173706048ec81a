"""Design columns: continuous terms, categorical expansion, interactions.

The design is a list of column expressions; nothing is computed here but the
levels of categorical variables.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass
from functools import reduce
from itertools import product
from operator import mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.formula import Factor, Formula
from lattica.plans.spec import MAX_LEVELS, resolve

log = logging.getLogger("lattica")

NEAR_INTEGER = 1e-6


@dataclass(frozen=True)
class DesignColumn:
    name: str
    value: Column
    endogenous: bool = False


def whole(column: str) -> Column:
    """The nearest integer, halves away from zero."""
    return F.round(F.col(column).cast("double")).try_cast("int")


def levels(df: DataFrame, columns, cap: int = MAX_LEVELS) -> dict[str, list[int]]:
    """Levels of categorical variables, ascending: the whole numbers among their values, the smallest ``cap`` of them.

    One job for all variables; a variable sends at most ``cap + 1`` numbers.
    Values over the cap, and values that are no whole numbers, get no column of
    their own.
    """
    if not columns:
        return {}
    pairs = F.array(*[F.struct(F.lit(c).alias("v"), F.col(c).cast("double").alias("x")) for c in columns])
    values = df.select(F.explode(pairs).alias("p")).where(F.abs(F.col("p.x") - F.round("p.x")) <= NEAR_INTEGER)
    values = values.select("p.v", F.round("p.x").try_cast("int").alias("level")).where("level is not null").distinct()
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("v").orderBy("level"))
    rows = values.withColumn("r", place).where(F.col("r") <= cap + 1).collect()
    found = {c: sorted(r["level"] for r in rows if r["v"] == c) for c in columns}
    for c, ls in found.items():
        if len(ls) > cap:
            log.warning("%s has more than %d levels: the others join the base", c, cap)
    return {c: ls[:cap] for c, ls in found.items()}


def dummies(column: str, found: list[int], base: int) -> list[tuple[str, Column]]:
    """A 0/1 column for each level but the base; a base that isn't a level is the first one."""
    base = base if base in found else found[0] if found else base
    return [(f"{column}:{level}", F.coalesce((whole(column) == level).cast("double"), F.lit(0.0))) for level in found if level != base]


def _block(factor: Factor, df: DataFrame, known: dict[str, list[int]]) -> list[tuple[str, Column]]:
    column = resolve(factor.name, df.columns)
    if column is None:
        log.warning("no column %r in the design: left out", factor.name)
        return []
    if factor.categorical:
        return dummies(column, known[column], factor.base)
    return [(column, F.col(column).cast("double"))]


def build(df: DataFrame, formula: Formula, cap: int = MAX_LEVELS) -> tuple[list[DesignColumn], list[DesignColumn]]:
    """Regressors (main terms in order of appearance, then interactions) and instruments."""
    factors = [*formula.terms, *(f for c in formula.interactions for f in c), *formula.instruments]
    wanted = [resolve(f.name, df.columns) for f in factors if f.categorical]
    known = levels(df, list(dict.fromkeys(c for c in wanted if c)), cap)
    endogenous = {f.name.lower() for f in formula.endogenous}
    design = []
    for factor in formula.terms:
        flag = factor.name.lower() in endogenous
        design += [DesignColumn(name, value, flag) for name, value in _block(factor, df, known)]
    for group in formula.interactions:
        flag = any(f.name.lower() in endogenous for f in group)
        for combination in product(*(_block(f, df, known) for f in group)):
            design.append(DesignColumn("&".join(n for n, _ in combination), reduce(mul, [v for _, v in combination]), flag))
    instruments = [DesignColumn(name, value) for f in formula.instruments for name, value in _block(f, df, known)]
    if endogenous and not any(c.endogenous for c in design):
        log.warning("no endogenous variable is among the regressors: this is least squares")
    return design, instruments
