"""What is estimated, and how names bind to columns."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

log = logging.getLogger("lattica")

MAX_LEVELS, MAX_CLUSTERS = 40, 3


@dataclass(frozen=True)
class FitOptions:
    """``tolerance`` bounds the largest group mean that absorption leaves.

    Options that only choose hardware or an iteration scheme are accepted by the
    command line and have no effect here.
    """

    tolerance: float = 1e-6
    max_iterations: int = 500
    max_levels: int = MAX_LEVELS
    drop_missing: bool = True
    cluster_by_position: bool = False
    local_cells: int = 5_000_000


@dataclass(frozen=True)
class ModelSpec:
    """Columns of a dataset by role."""

    y: str
    x: tuple[str, ...] = ()
    z: tuple[str, ...] = ()
    fe: tuple[str, ...] = ()
    cluster: str | None = None
    weights: str | None = None

    def columns(self) -> tuple[str, ...]:
        """Each column once, in order of first use."""
        extra = tuple(c for c in (self.cluster, self.weights) if c)
        return tuple(dict.fromkeys((self.y, *self.x, *self.fe, *self.z, *extra)))


def resolve(name: str, columns) -> str | None:
    """The column called ``name``, whatever the case."""
    return next((c for c in columns if c.lower() == name.lower()), None)


def bind(wanted, columns, what: str) -> tuple[str, ...]:
    """Columns for names, in order and once each; unknown names are left out with a warning."""
    found = []
    for name in wanted:
        column = resolve(name, columns)
        if column is None:
            log.warning("no column %r for %s: left out", name, what)
        elif column not in found:
            found.append(column)
    return tuple(found)


def bind_clusters(wanted, fe: tuple[str, ...], columns, by_position: bool = False) -> tuple[str, ...]:
    """Cluster columns, those that are fixed effects in the order of ``fe``; no more than three.

    If no name is known, ``by_position`` takes the first fixed effects instead of raising.
    """
    found = bind(wanted, columns, "clusters")
    if wanted and not found:
        if not by_position:
            raise ValueError(f"none of the cluster names {list(wanted)} is a column")
        found = fe[: len(wanted)]
    found = tuple(f for f in fe if f in found) + tuple(f for f in found if f not in fe)
    if len(found) > MAX_CLUSTERS:
        log.warning("more than %d cluster dimensions: the rest is left out", MAX_CLUSTERS)
    return found[:MAX_CLUSTERS]


def select_fe(fe: tuple[str, ...], positions, clusters=()) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Fixed effects by 1-based position, and the clusters that are still among them."""
    kept = tuple(fe[i - 1] for i in positions if 1 <= i <= len(fe))
    return kept, tuple(c for c in clusters if c in kept)


def rename_fe(fe: tuple[str, ...], names) -> dict[str, str]:
    """Old to new names; there must be one for each."""
    if len(names) != len(fe):
        raise ValueError(f"{len(names)} names for {len(fe)} fixed effects")
    return dict(zip(fe, names))


def by_position(columns: tuple[str, ...], positions, what: str) -> tuple[str, ...]:
    """Columns by 1-based position, ascending and once each; positions out of range are left out with a warning."""
    wrong = [p for p in positions if not 1 <= p <= len(columns)]
    if wrong:
        log.warning("%s out of range: %s", what, wrong)
    return tuple(columns[p - 1] for p in sorted(set(positions) - set(wrong)))


@dataclass
class EstimationResult:
    """Coefficients in order of the design, fit statistics and what was absorbed."""

    names: list[str]
    beta: list[float]
    se: list[float]
    n: int = 0
    df: int = 1
    fe_levels: dict[str, int] = field(default_factory=dict)
    fe_dof: int = 0
    rss: float = 0.0
    tss: float = 0.0
    tss_within: float = 0.0
    r2: float = 0.0
    r2_within: float = 0.0
    r2_adjusted: float = 0.0
    f_stat: float = 0.0
    clusters: dict[str, int] = field(default_factory=dict)
    endogenous: list[str] = field(default_factory=list)
    instruments: list[str] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)
    converged: bool = True
    iterations: int = 0
    solver_info: int = 0
    vcov: list[list[float]] = field(default_factory=list)
    #: Per fixed effect a frame (level, fe_value, n), if effects were asked for.
    effects: dict = field(default_factory=dict)

    def rows(self) -> list[tuple]:
        """(term, estimate, std_error, t, p, ci_low, ci_high); a dropped term has estimate 0 and p 1."""
        from lattica.functions.stats import t_quantile, two_sided_p

        reach = t_quantile(0.975, self.df)
        out = []
        for name, b, s in zip(self.names, self.beta, self.se):
            t = b / s if s > 0 else 0.0
            out.append((name, b, s, t, two_sided_p(t, self.df), b - reach * s, b + reach * s))
        return out

    def to_df(self, spark):
        kind = "term string, estimate double, std_error double, t double, p double, ci_low double, ci_high double"
        return spark.createDataFrame(self.rows(), kind)

    def stats_df(self, spark):
        kind = "n long, k int, df long, fe_dof long, rss double, tss double, tss_within double, r2 double, r2_within double, r2_adjusted double, f_stat double"
        row = (self.n, len(self.names), self.df, self.fe_dof, self.rss, self.tss, self.tss_within, self.r2, self.r2_within, self.r2_adjusted, self.f_stat)
        return spark.createDataFrame([row], kind)

    def summary(self) -> str:
        lines = [f"{'term':<24}{'estimate':>16}{'std. error':>16}{'t':>12}{'p':>12}{'95% low':>16}{'95% high':>16}"]
        if self.solver_info:
            return "solver failed: the normal equations are singular"
        lines += [f"{r[0]:<24}{r[1]:>16.8g}{r[2]:>16.8g}{r[3]:>12.4g}{r[4]:>12.4g}{r[5]:>16.8g}{r[6]:>16.8g}" for r in self.rows()]
        lines += [
            f"observations {self.n}, degrees of freedom {self.df}, absorbed {self.fe_dof}"
            + "".join(f", {name}: {g} levels" for name, g in self.fe_levels.items()),
            f"R2 {self.r2:.6f}, adjusted {self.r2_adjusted:.6f}, within {self.r2_within:.6f}, F {self.f_stat:.6g}",
            f"converged {self.converged} after {self.iterations} iterations",
        ]
        if self.clusters:
            lines.append("clusters: " + ", ".join(f"{name} ({g})" for name, g in self.clusters.items()))
        if self.endogenous:
            lines.append(f"endogenous: {', '.join(self.endogenous)}; instruments: {', '.join(self.instruments)}")
        return "\n".join(lines)
