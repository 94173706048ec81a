"""The estimation plan: formula and frame in, coefficients out.

Rows are read for means, for one matrix of products, and for the level sums and
pair counts of the fixed effects; clustered errors read them once more.
Everything else happens on matrices of the size of the design.
"""

from __future__ import annotations

import logging

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.formula import Formula, parse
from lattica.operators import cluster as clustering
from lattica.operators import design as designs
from lattica.operators import effects as recovery
from lattica.operators.gram import gram, moments
from lattica.operators.prepare import drop_missing, reject_missing
from lattica.operators.solve import clip_negative, solve, two_stage, with_variance
from lattica.operators.within import absorb, residualize
from lattica.plans.spec import EstimationResult, FitOptions, ModelSpec, bind, bind_clusters, resolve

log = logging.getLogger("lattica")


def _unit(x: float) -> float:
    return min(1.0, max(0.0, x))


def fit(df: DataFrame, formula: str | Formula, spec: ModelSpec | None = None, options: FitOptions | None = None, effects: bool = False) -> EstimationResult:
    """Least squares, or two-stage least squares, with any number of absorbed fixed effects.

    ``spec`` gives the roles of a panel file's columns: without ``fe(...)`` in the
    formula all its fixed effects are absorbed.  A plain frame has none, so the
    fit then goes through the origin, with a warning; R2 stays about the mean.
    """
    options = options or FitOptions()
    f = parse(formula) if isinstance(formula, str) else formula
    y = resolve(f.y, df.columns)
    if y is None:
        raise ValueError(f"no column {f.y!r} for the dependent variable")
    if f.fe is None:
        fe = spec.fe if spec else ()
        if not fe:
            log.warning("no fixed effects: the fit goes through the origin")
    else:
        fe = bind(f.fe, df.columns, "fixed effects")
    clusters = bind_clusters(f.cluster or (), fe, df.columns, options.cluster_by_position)
    factors = [*f.terms, *(x for c in f.interactions for x in c), *f.instruments]
    used = [y, *(c for c in (resolve(x.name, df.columns) for x in factors) if c), *fe, *clusters]
    used = list(dict.fromkeys(used))
    rows = df.select(*used)
    if options.drop_missing:
        rows = drop_missing(rows, used)
    else:
        reject_missing(rows, used)
    design, instruments = designs.build(rows, f, options.max_levels)

    # columns under names that can't clash: y, x.., z.., fixed effects f.., clusters c..
    xs, zs = [f"x{i}" for i in range(len(design))], [f"z{i}" for i in range(len(instruments))]
    dims = [f"f{i}" for i in range(len(fe))]
    cluster_dims = [dims[fe.index(c)] if c in fe else f"c{i}" for i, c in enumerate(clusters)]
    outside = [F.col(c).alias(d) for c, d in zip(clusters, cluster_dims) if c not in fe]
    data = rows.select(
        F.col(y).cast("double").alias("y"),
        *[c.value.alias(n) for c, n in zip(design, xs)],
        *[c.value.alias(n) for c, n in zip(instruments, zs)],
        *[F.col(c).alias(d) for c, d in zip(fe, dims)],
        *outside,
    )
    numeric = ["y", *xs, *zs]
    n, means = moments(data, numeric)
    if not n:
        raise ValueError("no observations remain")
    result = EstimationResult([c.name for c in design], [0.0] * len(design), [0.0] * len(design), n=n)

    absorbed = absorb(data, dims, numeric, means, options.tolerance, options.max_iterations, options.local_cells)
    if not absorbed.converged:
        log.warning("absorption did not converge in %d iterations", absorbed.iterations)
    result.converged, result.iterations = absorbed.converged, absorbed.iterations
    result.fe_levels = {c: absorbed.levels[d] for c, d in zip(fe, dims)}
    if dims:
        centred = gram(data.select(*[(F.col(c) - F.lit(float(m))).alias(c) for c, m in zip(numeric, means)]), numeric)
        g, result.tss = centred - absorbed.correction, float(centred[0, 0])
    else:
        g = gram(data, numeric)
        result.tss = max(0.0, data.agg(F.var_pop("y") * F.count("*")).first()[0] or 0.0)
    result.tss_within = float(g[0, 0])
    if not design:
        return result

    # normal equations
    k = len(design)
    x, z = list(range(1, k + 1)), list(range(k + 1, k + 1 + len(instruments)))
    endogenous = [i for i, c in enumerate(design) if c.endogenous]
    iv = bool(endogenous) and len(instruments) >= len(endogenous)
    if endogenous and not iv:
        log.warning("fewer instruments than endogenous variables: this is least squares")
    projection, star = None, []
    if iv:
        result.endogenous = [design[i].name for i in endogenous]
        result.instruments = [c.name for c in instruments]
        star = [x[i] for i in range(k) if i not in endogenous] + z
        staged = two_stage(g, 0, x, star)
        if staged is None:
            result.solver_info = 1
            log.error("the instruments are collinear or constant within the fixed effects")
            return result
        q, b, projection = staged
    else:
        q, b = g[np.ix_(x, x)], g[x, 0]
    kept = with_variance(q)
    result.dropped = [design[i].name for i in range(k) if i not in kept]
    if not kept:
        result.solver_info = -1
        return result
    solved = solve(q[np.ix_(kept, kept)], b[kept])
    if solved is None:
        result.solver_info = 1
        log.error("the regressors are collinear")
        return result
    beta = np.zeros(k)
    beta[kept], bread = solved
    result.beta = beta.tolist()

    # fit
    full = np.concatenate([[1.0], -beta])
    own = g[: k + 1, : k + 1]
    result.rss = max(0.0, float(full @ own @ full))
    result.fe_dof = sum(max(0, v - 1) for v in result.fe_levels.values())
    result.df = df_plain = max(1, n - (len(kept) + result.fe_dof + 1))
    vcov = result.rss / result.df * bread
    if clusters:
        vcov, result.clusters = _clustered(data, absorbed, dims, cluster_dims, numeric, beta, kept, projection, star, bread, n)
        result.clusters = {c: result.clusters[d] for c, d in zip(clusters, cluster_dims)}
        result.df = max(1, min(result.clusters.values()) - 1)
    se = np.zeros(k)
    se[kept] = np.sqrt(np.maximum(np.diag(vcov), 0.0))
    result.se, result.vcov = se.tolist(), vcov.tolist()
    tiny = 1e-12
    if result.tss > tiny:
        result.r2 = _unit(1 - result.rss / result.tss)
        result.r2_adjusted = _unit(1 - result.rss * (n - 1) / (result.tss * max(df_plain, 1))) if n > 1 else result.r2
    result.r2_within = _unit(1 - result.rss / result.tss_within) if result.tss_within > tiny else result.r2
    if result.rss > tiny:
        result.f_stat = max(0.0, result.tss - result.rss) / len(kept) / (result.rss / result.df)
    if effects:
        found = recovery.recover(absorbed, beta)
        result.effects = {c: found[d] for c, d in zip(fe, dims)}
    return result


def _clustered(data, absorbed, dims, cluster_dims, numeric, beta, kept, projection, star, bread, n):
    """Covariance by clusters; scores are residuals times regressors, projected ones under instruments."""
    within = residualize(data, absorbed, dims, keep=cluster_dims)
    residual = F.col("y")
    for i, b in enumerate(beta):
        if b:
            residual = residual - F.lit(float(b)) * F.col(f"x{i}")
    scores = []
    for s, i in enumerate(kept):
        value = F.col(f"x{i}")
        if projection is not None:
            value = sum((F.lit(float(projection[r, i])) * F.col(numeric[c]) for r, c in enumerate(star)), F.lit(0.0))
        scores.append((residual * value).alias(f"s{s}"))
    names = [f"s{s}" for s in range(len(kept))]
    table = clustering.meats(within.select(*cluster_dims, *scores), cluster_dims, names).collect()  # 7 rows at most
    nested = any(absorbed.levels.get(d, 0) > 1 for d in cluster_dims)
    vcov, singles = clustering.clustered_vcov(table, cluster_dims, len(kept), bread, n, nested)
    return clip_negative(vcov), singles
