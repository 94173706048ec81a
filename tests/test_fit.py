import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica import FitOptions, fit
from lattica.operators.gram import gram, moments
from lattica.operators.solve import clip_negative
from lattica.operators.within import absorb, residualize

GOLDEN_DIR = "/root/testdata/sf0.01"
TIGHT = FitOptions(tolerance=1e-12)


@pytest.fixture(scope="module")
def lines(spark):
    return spark.read.parquet(f"{GOLDEN_DIR}/lineitem.parquet").withColumn("y", F.col("l_extendedprice") / 1000).cache()


@pytest.fixture(scope="module")
def six(spark):
    rows = [(1.0, -2.0, 1, 1, 0.1), (1.5, 0.5, 1, 2, 0.7), (-0.5, 1.0, 2, 1, -0.65), (-1.0, -1.5, 2, 2, -0.05), (0.25, 0.75, 3, 1, 0.4), (2.0, 1.25, 3, 2, 1.0)]
    return spark.createDataFrame(rows, "w1 double, w2 double, a int, b int, f double").withColumn("y", 1.5 * F.col("w1") - 0.75 * F.col("w2") + F.col("f"))


def test_six_rows_without_noise(six):
    r = fit(six, "y ~ w1 w2, fe(a b)", options=FitOptions(tolerance=1e-12))
    assert np.allclose(r.beta, [1.5, -0.75], atol=1e-8) and r.df == 1


@pytest.mark.parametrize("cells", [5_000_000, 0])
def test_group_means_vanish(spark, cells):
    rows = list(zip([1.0, 2.0, 3.0, -2.0, -1.0, 0.5], [1.0, 1.5, -0.5, -1.0, 2.0, -0.5], [0.0, -2.0, 1.0, 0.5, 1.5, -1.0], [1, 1, 2, 2, 3, 3], [1, 2, 1, 2, 1, 2]))
    df = spark.createDataFrame(rows, "y double, w1 double, w2 double, a int, b int")
    names = ["y", "w1", "w2"]
    _, means = moments(df, names)
    done = absorb(df, ["a", "b"], names, means, 1e-10, 500, cells)
    assert done.converged
    within = residualize(df, done, ["a", "b"]).toPandas()
    for d in ("a", "b"):
        assert within.groupby(d)[names].mean().abs().to_numpy().max() < 1e-6
    x = within[names].to_numpy()
    centred = gram(df.select(*[(F.col(c) - float(m)).alias(c) for c, m in zip(names, means)]), names)
    assert np.allclose(x.T @ x, centred - done.correction, atol=1e-8)


@pytest.mark.parametrize(
    "fe, beta, plain, clustered, df",
    [
        ("l_suppkey", (0.007032790099, 6.457012776879), (0.008514738708, 4.230925248448), (0.009111914875, 3.838636744373), (59898, 99)),
        ("l_suppkey l_partkey", (0.009041854541, 5.966622236341), (0.008660484227, 4.313001126336), (0.008675502417, 3.826407697450), (57899, 99)),
        ("l_suppkey l_partkey l_returnflag", (0.009036789407, 5.963510199691), (0.008660881898, 4.313083555446), (0.006487533109, 4.187369476574), (57897, 2)),
    ],
)
def test_golden(lines, fe, beta, plain, clustered, df):
    for options, se, free in (("", plain, df[0]), (f" cluster({fe})", clustered, df[1])):
        r = fit(lines, f"y ~ l_quantity l_discount, fe({fe}){options}", options=TIGHT)
        assert np.allclose(r.beta, beta, rtol=1e-9) and np.allclose(r.se, se, rtol=1e-8) and r.df == free


def test_dummies_equal_absorption(lines):
    some = lines.where("l_orderkey < 3000")
    absorbed = fit(some, "y ~ l_quantity, fe(l_linenumber)", options=TIGHT)
    x = some.select("y", "l_quantity", "l_linenumber").toPandas()
    design = np.column_stack([x.l_quantity, *[(x.l_linenumber == k) for k in range(1, 8)]]).astype(float)
    assert math.isclose(absorbed.beta[0], np.linalg.lstsq(design, x.y, rcond=None)[0][0], rel_tol=1e-8)


def test_wide_gram_equals_narrow(spark):
    rng = np.random.default_rng(0).normal(size=(50, 26))
    names = [f"c{i}" for i in range(26)]
    df = spark.createDataFrame(rng.tolist(), ", ".join(f"{c} double" for c in names))
    assert np.allclose(gram(df, names), rng.T @ rng)


def test_constant_column_is_dropped_and_stays_listed(six):
    r = fit(six.withColumn("c", F.col("a") * 2.0), "y ~ w1 c, fe(a)")
    assert r.dropped == ["c"] and r.beta[1] == 0 and r.rows()[1][4] == 1.0


def test_collinear_regressors_are_an_error(six):
    r = fit(six.withColumn("v", F.col("w1") * 2), "y ~ w1 v, fe(a)")
    assert r.solver_info == 1 and "failed" in r.summary()


def test_no_regressors_and_missing(six, spark):
    assert fit(six, "y ~ nothing, fe(a)").names == []
    holes = six.union(spark.createDataFrame([(None, 1.0, 1, 1, 0.0, 1.0), (float("nan"), 1.0, 1, 1, 0.0, 1.0)], six.schema))
    assert fit(holes, "y ~ w1, fe(a)").n == 6
    with pytest.raises(ValueError):
        fit(holes, "y ~ w1, fe(a)", options=FitOptions(drop_missing=False))
    with pytest.raises(ValueError):
        fit(six.limit(0), "y ~ w1, fe(a)")
    with pytest.raises(ValueError):
        fit(six, "nope ~ w1")
    with pytest.raises(ValueError):
        fit(six, "y ~ w1, fe(a) cluster(nope)")


def test_columns_called_like_internal_ones(six):
    named = six.withColumnsRenamed({"a": "n", "b": "s0", "w1": "x0", "w2": "level"})
    r = fit(named, "y ~ x0 level, fe(n s0) cluster(n)", effects=True)
    assert np.allclose(r.beta, [1.5, -0.75], atol=1e-6) and set(r.effects) == {"n", "s0"}


def test_two_stage_with_itself_as_instrument_is_least_squares(lines):
    df = lines.withColumn("z", F.col("l_quantity"))
    a, b = fit(df, "y ~ l_quantity l_discount (l_quantity ~ z), fe(l_suppkey)"), fit(df, "y ~ l_quantity l_discount, fe(l_suppkey)")
    assert np.allclose(a.beta, b.beta) and np.allclose(a.se, b.se) and a.instruments == ["z"]


def test_too_few_instruments_is_least_squares(lines):
    r = fit(lines, "y ~ l_quantity l_discount (l_quantity l_discount ~ l_tax), fe(l_suppkey)")
    assert not r.instruments and not r.endogenous


def test_effects_rebuild_y(six):
    r = fit(six, "y ~ w1 w2, fe(a b)", options=FitOptions(tolerance=1e-12), effects=True)
    got = {d: {x["level"]: x["fe_value"] for x in t.collect()} for d, t in r.effects.items()}
    rows = six.collect()
    mean = np.mean([x["f"] for x in rows])
    for x in rows:
        assert math.isclose(got["a"][x["a"]] + got["b"][x["b"]] + mean, x["f"], abs_tol=1e-8)


def test_clipping():
    v = clip_negative(np.array([[1.0, 2.0], [2.0, 1.0]]))
    assert np.linalg.eigvalsh(v).min() > -1e-12


def test_tables_solve_as_the_driver_does(spark):
    """Connected workers and firms, some levels with one row; the same effects and coefficients in a few steps."""
    rng = np.random.default_rng(12)
    n = 1200
    worker, firm = rng.integers(0, 150, n), rng.integers(0, 25, n)
    x = rng.normal(size=n) + worker / 50
    y = 1.5 * x + worker / 10 - firm / 3 + rng.normal(size=n)
    df = spark.createDataFrame([(float(a), float(b), int(w), int(f)) for a, b, w, f in zip(y, x, worker, firm)], "y double, x double, worker int, firm int").coalesce(1).cache()
    here, there = (fit(df, "y ~ x, fe(worker firm)", options=FitOptions(tolerance=1e-7, local_cells=c)) for c in (5_000_000, 0))
    assert there.converged and there.iterations < 60
    assert there.beta == pytest.approx(here.beta, abs=1e-7) and there.se == pytest.approx(here.se, rel=1e-6)
