"""Absorption of fixed effects in coefficient space.

For every column v there are level effects a_d with v~ = v - sum_d a_d[level]
whose sums over each level of each dimension vanish.  With one dimension they
are means.  With more they solve normal equations that only hold per-level sums
and numbers of rows per pair of levels, so after these aggregates the rows are
not read again: conjugate gradients on the driver while the equations have at
most ``local_cells`` numbers, else the same over tables, a step of which joins each
pair of dimensions once and writes one table per dimension.

Products of absorbed columns need no rows either: u~'v~ = u'v - sum of effects
of u times level sums of v.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Absorbed:
    """Effects of each dimension: a frame (dimension, n, a0, a1, ...) with one column per absorbed column."""

    columns: list[str]
    means: np.ndarray
    effects: dict[str, DataFrame] = field(default_factory=dict)
    levels: dict[str, int] = field(default_factory=dict)
    correction: np.ndarray | None = None
    converged: bool = True
    iterations: int = 0


def materialize(df: DataFrame, name: str, cut: bool = False) -> DataFrame:
    """A table in the shared checkpoint folder; where none is named the cache, or with ``cut`` (lineage must end) a folder of this machine in local mode."""
    spark = df.sparkSession
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base and not cut:
        return df.cache()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.gettempdir()
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(tables) -> None:
    """Give up what ``materialize`` returned, once nothing reads it any more."""
    for table in tables:
        path = getattr(table, "written_to", None)
        if not path:
            table.unpersist()
            continue
        context = table.sparkSession.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def level_sums(df: DataFrame, dim: str, columns, means) -> DataFrame:
    """Per level: n and the sum of each column about its grand mean (s0, s1, ...)."""
    sums = [F.sum(F.col(c) - F.lit(float(m))).alias(f"s{i}") for i, (c, m) in enumerate(zip(columns, means))]
    return df.groupBy(dim).agg(F.count("*").alias("n"), *sums)


def absorb(df: DataFrame, dims, columns, means, tolerance: float = 1e-8, max_iterations: int = 500, local_cells: int = 5_000_000) -> Absorbed:
    """Effects of ``dims`` for ``columns`` about ``means``; ``tolerance`` bounds every group mean that is left."""
    out = Absorbed(list(columns), means)
    k = len(columns)
    out.correction = np.zeros((k, k))
    if not dims:
        return out
    sums = {d: materialize(level_sums(df, d, columns, means), "level-sums") for d in dims}
    out.levels = {d: s.count() for d, s in sums.items()}
    if len(dims) == 1:
        d = dims[0]
        out.effects[d] = sums[d].select(d, "n", *[(F.col(f"s{i}") / F.col("n")).alias(f"a{i}") for i in range(k)])
        out.iterations = 1
    else:
        order = sorted(dims, key=lambda d: out.levels[d])
        pairs = {p: materialize(df.groupBy(*p).agg(F.count("*").alias("n")), "level-pairs") for p in combinations(order, 2)}
        cells = sum(p.count() for p in pairs.values()) + k * sum(out.levels.values())
        solve = _solve_local if cells <= local_cells else _solve_tables
        solve(out, order, sums, pairs, tolerance, max_iterations)
        discard(pairs.values())
        if solve is _solve_local:
            discard(sums.values())
            return out
    products = [(i, j) for i in range(k) for j in range(i, k)]
    for d in dims:
        joined = out.effects[d].join(sums[d].drop("n"), d)
        row = joined.agg(*[F.sum(F.col(f"a{i}") * F.col(f"s{j}")).alias(f"p{i}_{j}") for i, j in products]).first()
        for (i, j), x in zip(products, row):
            out.correction[i, j] += x or 0.0
    out.correction = np.triu(out.correction) + np.triu(out.correction, 1).T
    return out


def _solve_local(out: Absorbed, order, sums, pairs, tolerance: float, max_iterations: int) -> None:
    k = len(out.columns)
    spark = next(iter(sums.values())).sparkSession
    tables = {d: sums[d].toArrow().to_pandas().sort_values(d, ignore_index=True) for d in order}
    place = {d: pd.Index(t[d]) for d, t in tables.items()}
    shift, total = {}, 0
    for d in order:
        shift[d], total = total, total + len(tables[d])
    n = np.concatenate([tables[d]["n"].to_numpy(float) for d in order])
    right = np.vstack([tables[d][[f"s{i}" for i in range(k)]].to_numpy(float) for d in order])
    rows, cols, weight = [], [], []
    for (a, b), frame in pairs.items():
        t = frame.toArrow().to_pandas()
        i, j = place[a].get_indexer(t[a]) + shift[a], place[b].get_indexer(t[b]) + shift[b]
        rows += [i, j]
        cols += [j, i]
        weight += [t["n"].to_numpy(float)] * 2
    rows, cols, weight = map(np.concatenate, (rows, cols, weight))

    def apply(v: np.ndarray) -> np.ndarray:
        crossed = np.column_stack([np.bincount(rows, weight * v[cols, c], total) for c in range(v.shape[1])])
        return n[:, None] * v + crossed

    x, r = np.zeros_like(right), right.copy()
    z = r / n[:, None]
    p, rz = z.copy(), (r * z).sum(0)
    out.converged = False
    for step in range(1, max_iterations + 1):
        out.iterations = step
        if np.abs(z).max(initial=0.0) < tolerance:
            out.converged = True
            break
        ap = apply(p)
        along = (p * ap).sum(0)
        rate = np.where(along > 0, rz / np.where(along > 0, along, 1.0), 0.0)
        x += rate * p
        r = right - apply(x) if step % 50 == 0 else r - rate * ap
        z = r / n[:, None]
        new = (r * z).sum(0)
        p = z + np.where(rz > 0, new / np.where(rz > 0, rz, 1.0), 0.0) * p
        rz = new
    crossed = x.T @ right
    out.correction = (crossed + crossed.T) / 2
    for d in order:
        t = tables[d][[d, "n"]].copy()
        for i in range(k):
            t[f"a{i}"] = x[shift[d] : shift[d] + len(t), i]
        made = spark.createDataFrame(pa.Table.from_pandas(t, preserve_index=False))
        out.effects[d] = made.withColumn(d, F.col(d).cast(sums[d].schema[d].dataType))


def _solve_tables(out: Absorbed, order, sums, pairs, tolerance: float, max_iterations: int) -> None:
    """Conjugate gradients on tables: of each dimension one with the solution x, the residual r and the direction p of each level.

    The driver holds a few sums per column; every step's tables replace the last one's.
    """
    k = len(out.columns)
    each = range(k)
    start = [F.col(f"s{i}") for i in each]
    state = {d: sums[d].select(d, "n", *[F.lit(0.0).alias(f"x{i}") for i in each], *[s.alias(f"r{i}") for i, s in enumerate(start)], *[(s / F.col("n")).alias(f"p{i}") for i, s in enumerate(start)]) for d in order}

    def totals(tables, *sums_of) -> np.ndarray:
        rows = [tables[d].agg(*[F.coalesce(F.sum(e), F.lit(0.0)) for e in sums_of]).first() for d in order]
        return np.array(rows, float).sum(0)

    def worst(tables) -> float:
        left = F.greatest(*[F.max(F.abs(F.col(f"r{i}") / F.col("n"))) for i in each], F.lit(0.0))
        return max(tables[d].agg(left).first()[0] or 0.0 for d in order)

    weighted = [F.col(f"r{i}") * F.col(f"r{i}") / F.col("n") for i in each]
    rz, tables, out.converged = totals(state, *weighted), {}, False
    for step in range(1, max_iterations + 1):
        out.iterations = step
        if worst(state) < tolerance:
            out.converged = True
            break
        last, tables = tables, {}
        for d in order:
            applied = state[d].withColumns({f"q{i}": F.col("n") * F.col(f"p{i}") for i in each})
            for e in (e for e in order if e != d):
                pair = pairs[(d, e) if (d, e) in pairs else (e, d)]
                explained = pair.join(state[e].select(e, *[f"p{i}" for i in each]), e).groupBy(d)
                explained = explained.agg(*[F.sum(F.col("n") * F.col(f"p{i}")).alias(f"e{i}") for i in each])
                applied = applied.join(explained, d).withColumns({f"q{i}": F.col(f"q{i}") + F.col(f"e{i}") for i in each}).drop(*[f"e{i}" for i in each])
            tables[d] = materialize(applied, "lattica-effects", cut=True)
        along = totals(tables, *[F.col(f"p{i}") * F.col(f"q{i}") for i in each])
        rate = np.where(along > 0, rz / np.where(along > 0, along, 1.0), 0.0)
        moved = {}
        for i in each:
            moved[f"x{i}"] = F.col(f"x{i}") + F.lit(float(rate[i])) * F.col(f"p{i}")
            moved[f"r{i}"] = F.col(f"r{i}") - F.lit(float(rate[i])) * F.col(f"q{i}")
        state = {d: tables[d].withColumns(moved) for d in order}
        new = totals(state, *weighted)
        turn = np.where(rz > 0, new / np.where(rz > 0, rz, 1.0), 0.0)
        turned = {f"p{i}": F.col(f"r{i}") / F.col("n") + F.lit(float(turn[i])) * F.col(f"p{i}") for i in each}
        state = {d: state[d].withColumns(turned).drop(*[f"q{i}" for i in each]) for d in order}
        rz = new
        discard(last.values())
    out.effects = {d: state[d].select(d, "n", *[F.col(f"x{i}").alias(f"a{i}") for i in each]) for d in order}


def residualize(df: DataFrame, absorbed: Absorbed, dims, keep=()) -> DataFrame:
    """The rows with each absorbed column less its effects (and its grand mean, if anything is absorbed), under its name.

    One join per dimension with a table of its levels; sizes decide how.
    """
    if not dims:
        return df.select(*dict.fromkeys([*keep, *absorbed.columns]))
    values = {c: F.col(c) - F.lit(float(m)) for c, m in zip(absorbed.columns, absorbed.means)}
    for t, d in enumerate(dims):
        effect = absorbed.effects[d].select(d, *[F.col(f"a{i}").alias(f"_a{t}_{i}") for i in range(len(values))])
        df = df.join(effect, d)
        values = {c: v - F.col(f"_a{t}_{i}") for i, (c, v) in enumerate(values.items())}
    return df.select(*dict.fromkeys([*keep, *dims]), *[v.alias(c) for c, v in values.items()])
