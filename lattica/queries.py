"""Named queries over the star-schema tables, one per operator of the engine."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.formula import Factor, parse
from lattica.operators import design, gram, prepare, within
from lattica.operators.cluster import meats
from lattica.plans.estimate import fit
from lattica.plans.spec import EstimationResult, FitOptions, ModelSpec
from lattica.sources.panel import read_panel, write_panel
from lattica.sources.synthetic import build_panel, run_counter

TIGHT = FitOptions(tolerance=1e-11)


def _r(c, digits: int = 6) -> Column:
    """Rounded for comparison; without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with the price in thousands."""
    return _table(spark, sf_dir, "lineitem").withColumn("price", F.col("l_extendedprice") / 1000)


def _coefficients(spark: SparkSession, r: EstimationResult, digits: int = 6) -> DataFrame:
    return r.to_df(spark).select("term", _r("estimate", digits).alias("estimate"), _r("std_error", digits).alias("std_error"))


def _betas(spark: SparkSession, r: EstimationResult) -> DataFrame:
    return r.to_df(spark).select("term", _r("estimate").alias("estimate"))


def null_drop(spark, sf_dir):
    holes = _lines(spark, sf_dir).withColumn("l_tax", F.when(F.col("l_linenumber") != 7, F.col("l_tax")))
    kept = prepare.drop_missing(prepare.prune(holes, ["price", "l_tax", "l_suppkey", "price"]))
    return kept.agg(F.count("*").alias("n"), _r(F.sum("price"), 3).alias("price"))


def group_sizes(spark, sf_dir):
    sizes = prepare.group_sizes(_lines(spark, sf_dir), ["l_suppkey", "l_partkey", "l_returnflag"])
    return spark.createDataFrame(list(sizes.items()), "dim string, levels long")


def dense_ids(spark, sf_dir):
    return prepare.dense_ids(_table(spark, sf_dir, "orders"), "o_custkey")


def dense_ids_text(spark, sf_dir):
    return prepare.dense_ids(_table(spark, sf_dir, "part"), "p_brand")


def factor_levels(spark, sf_dir):
    found = design.levels(_table(spark, sf_dir, "part").withColumn("half", F.col("p_size") / 2), ["p_size", "half"])
    return spark.createDataFrame([(c, x) for c, xs in found.items() for x in xs], "variable string, level int")


def _design_sums(spark, sf_dir, formula: str) -> DataFrame:
    df = _lines(spark, sf_dir)
    columns, _ = design.build(df, parse(formula))
    sums = df.agg(*[F.sum(c.value).alias(f"s{i}") for i, c in enumerate(columns)])
    pairs = F.array(*[F.struct(F.lit(c.name).alias("term"), F.col(f"s{i}").alias("total")) for i, c in enumerate(columns)])
    return sums.select(F.explode(pairs).alias("p")).select("p.term", _r("p.total", 4).alias("total"))


def categorical_terms(spark, sf_dir):
    return _design_sums(spark, sf_dir, "price ~ i.l_linenumber")


def categorical_base(spark, sf_dir):
    return _design_sums(spark, sf_dir, "price ~ i.3.l_linenumber")


def interactions(spark, sf_dir):
    return _design_sums(spark, sf_dir, "price ~ l_discount&i.l_linenumber")


def crossed_terms(spark, sf_dir):
    return _design_sums(spark, sf_dir, "price ~ l_quantity##l_discount##l_tax")


def group_stats(spark, sf_dir):
    stats = gram.group_stats(_lines(spark, sf_dir), "l_suppkey", ["price", "l_quantity"])
    return stats.select("l_suppkey", "n", _r("sum_price", 4).alias("sum_price"), _r("mean_price", 9).alias("mean_price"), _r("sum_l_quantity", 4).alias("sum_quantity"), _r("mean_l_quantity", 9).alias("mean_quantity"))


def demean_one(spark, sf_dir):
    df = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_suppkey", "price", "l_quantity")
    columns = ["price", "l_quantity"]
    _, means = gram.moments(df, columns)
    absorbed = within.absorb(df, ["l_suppkey"], columns, means)
    rows = within.residualize(df, absorbed, ["l_suppkey"], keep=["l_orderkey", "l_linenumber"])
    return rows.select("l_orderkey", "l_linenumber", _r("price", 9).alias("price"), _r("l_quantity", 9).alias("quantity"))


def gram_matrix(spark, sf_dir):
    names = ["price", "l_quantity", "l_discount", "l_tax"]
    g = gram.gram(_lines(spark, sf_dir).select(*[(F.col(c) / 100).alias(c) for c in names]), names)
    rows = [(a, b, float(g[i, j])) for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    return spark.createDataFrame(rows, "a string, b string, x double").select("a", "b", _r("x", 4).alias("x"))


def ols_one(spark, sf_dir):
    return _coefficients(spark, fit(_lines(spark, sf_dir), "price ~ l_quantity l_discount, fe(l_suppkey)", options=TIGHT))


def ols_none(spark, sf_dir):
    return _betas(spark, fit(_lines(spark, sf_dir), "price ~ l_quantity l_discount, fe()", options=TIGHT))


def fit_statistics(spark, sf_dir):
    s = fit(_lines(spark, sf_dir), "price ~ l_quantity l_discount, fe(l_suppkey)", options=TIGHT).stats_df(spark)
    return s.select("n", "df", "fe_dof", _r(F.col("rss") / 1000).alias("rss"), _r(F.col("tss") / 1000).alias("tss"), _r("r2", 9).alias("r2"), _r("r2_within", 9).alias("r2_within"), _r("r2_adjusted", 9).alias("r2_adjusted"), _r("f_stat").alias("f_stat"))


def ols_two(spark, sf_dir):
    return _betas(spark, fit(_lines(spark, sf_dir), "price ~ l_quantity l_discount, fe(l_suppkey l_partkey)", options=TIGHT))


def ols_three(spark, sf_dir):
    return _betas(spark, fit(_lines(spark, sf_dir), "price ~ l_quantity l_discount, fe(l_suppkey l_partkey l_returnflag)", options=TIGHT))


def composite_clusters(spark, sf_dir):
    return prepare.composite_clusters(_lines(spark, sf_dir), ["l_suppkey", "l_partkey", "l_returnflag"])


def cluster_meats(spark, sf_dir):
    df = _lines(spark, sf_dir).select("l_suppkey", "l_linenumber", "l_returnflag", (F.col("price") / 100).alias("s0"), (F.col("l_quantity") / 100).alias("s1"))
    out = meats(df, ["l_suppkey", "l_linenumber", "l_returnflag"], ["s0", "s1"])
    return out.select("dims", "clusters", *[_r(F.col(m) / 1000, 4).alias(m) for m in ("m0_0", "m0_1", "m1_1")])


def cluster_one(spark, sf_dir):
    return _coefficients(spark, fit(_lines(spark, sf_dir), "price ~ l_quantity l_discount, fe(l_suppkey) cluster(l_suppkey)", options=TIGHT))


def cluster_two(spark, sf_dir):
    return _coefficients(spark, fit(_lines(spark, sf_dir), "price ~ l_quantity, fe(l_suppkey) vce(cluster l_suppkey l_linenumber)", options=TIGHT))


def cluster_three(spark, sf_dir):
    f = "price ~ l_quantity l_discount, fe(l_suppkey l_partkey l_returnflag) cluster(l_suppkey l_partkey l_returnflag)"
    return _coefficients(spark, fit(_lines(spark, sf_dir), f, options=TIGHT))


def two_stage(spark, sf_dir):
    df = _lines(spark, sf_dir).withColumn("z", F.col("l_quantity") + F.col("l_orderkey") % 7)
    return _coefficients(spark, fit(df, "price ~ l_quantity l_discount (l_quantity ~ z), fe(l_suppkey)", options=TIGHT))


def two_stage_clustered(spark, sf_dir):
    df = _lines(spark, sf_dir).withColumns({"z1": F.col("l_quantity") + F.col("l_orderkey") % 7, "z2": F.col("l_quantity") + F.col("l_partkey") % 5})
    return _coefficients(spark, fit(df, "price ~ l_quantity l_discount (l_quantity ~ z1 z2), fe(l_suppkey) cluster(l_suppkey)", options=TIGHT))


def effects(spark, sf_dir):
    r = fit(_lines(spark, sf_dir), "price ~ l_quantity l_discount, fe(l_suppkey)", options=TIGHT, effects=True)
    return r.effects["l_suppkey"].select(F.col("level").alias("l_suppkey"), "n", _r("fe_value").alias("fe_value"))


def effects_two(spark, sf_dir):
    r = fit(_lines(spark, sf_dir), "price ~ l_quantity, fe(l_suppkey l_linenumber)", options=TIGHT, effects=True)
    return r.effects["l_linenumber"].select(F.col("level").alias("l_linenumber"), "n", _r("fe_value", 5).alias("fe_value"))


def tenure(spark, sf_dir):
    events = _table(spark, sf_dir, "events").groupBy("user_id", "ts").agg(F.min("event_type").alias("event_type"))
    runs = run_counter(events, "user_id", "ts", "event_type")
    return runs.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("tenure").cast("long").alias("total"), F.max("tenure").cast("long").alias("longest"))


def text_fixed_effects(spark, sf_dir):
    df = _table(spark, sf_dir, "orders").withColumn("price", F.col("o_totalprice") / 1000).withColumn("day", F.dayofmonth("o_orderdate").cast("double"))
    return _betas(spark, fit(df, "price ~ day, fe(o_orderpriority)", options=TIGHT))


def formula_terms(spark, sf_dir):
    """The parsed terms of a formula with every kind of syntax."""
    f = parse("price ~ a i.b c&i.2.d e##i.f a (a i.b ~ z1 i.z2), fe(g h) vce(cluster g)")
    name = lambda x: ("i." if x.categorical else "") + x.name
    rows = [("term", i, name(t)) for i, t in enumerate(f.terms)] + [("interaction", i, "&".join(map(name, c))) for i, c in enumerate(f.interactions)]
    rows += [(k, i, name(x) if isinstance(x, Factor) else x) for k, xs in (("endogenous", f.endogenous), ("instrument", f.instruments), ("fe", f.fe), ("cluster", f.cluster)) for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "kind string, place int, name string")


def panel_file(spark, sf_dir):
    """Suppliers written as a panel file and read back, in two row ranges."""
    spec = ModelSpec("s_acctbal", ("s_suppkey",), (), ("s_nationkey",))
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    folder = shared.removeprefix("file://").removeprefix("file:") if shared.startswith(("file:", "/")) else tempfile.mkdtemp(prefix="lattica-")
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"panel-{uuid.uuid4().hex}.bin")
    write_panel(_table(spark, sf_dir, "supplier"), path, spec)
    return read_panel(spark, path, 2)[0]


def synthetic(spark, sf_dir):
    """Estimates on a generated panel with known coefficients 0.4 and -0.2."""
    return _betas(spark, fit(build_panel(spark), "wage ~ tenure sick_shock, fe(worker firm time)", options=TIGHT))


QUERIES = {
    f"fe_{f.__name__}": f
    for f in (
        null_drop, group_sizes, dense_ids, dense_ids_text, factor_levels, categorical_terms, categorical_base, interactions,
        crossed_terms, group_stats, demean_one, gram_matrix, ols_one, ols_none, fit_statistics, ols_two, ols_three,
        composite_clusters, cluster_meats, cluster_one, cluster_two, cluster_three, two_stage, two_stage_clustered, effects,
        effects_two, tenure, text_fixed_effects, formula_terms, panel_file, synthetic,
    )
}
