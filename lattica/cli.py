"""Command line: ``python -m lattica.cli estimate|convert|synthesize ...``."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from lattica import FitOptions, ModelSpec, fit
from lattica.functions.formula import Factor, Formula, names, parse
from lattica.operators.effects import write_csv
from lattica.plans.spec import by_position, rename_fe
from lattica.sources.config import RunConfig, load_config
from lattica.sources.panel import read_panel, summary_json, write_panel
from lattica.sources.synthetic import PanelOptions, build_panel
from lattica.sources.tabular import guess_format, read_table, write_parquet

log = logging.getLogger("lattica")
TRACE = 5


def _positions(text: str) -> tuple[int, ...]:
    return tuple(int(x) for x in text.replace(",", " ").split())


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lattica")
    top.add_argument("--log-level", default="WARNING", choices=["TRACE", "DEBUG", "INFO", "WARNING", "ERROR"])
    commands = top.add_subparsers(dest="command", required=True)
    e = commands.add_parser("estimate", help="fit a model")
    e.add_argument("-d", "--data")
    e.add_argument("--config")
    e.add_argument("--formula")
    e.add_argument("--fe-tol", type=float)
    e.add_argument("--fe-max-iters", type=int)
    e.add_argument("--cluster-fe", type=_positions)
    e.add_argument("--iv-cols", type=_positions)
    e.add_argument("--iv-z-cols", type=_positions)
    e.add_argument("--save-fe")
    e.add_argument("--verbose", action="store_true")
    e.add_argument("--cpu-threads", type=int, help="no effect")
    for flag in ("--cpu-only", "--gpu", "--fast", "--demean-cg"):
        e.add_argument(flag, action="store_true", help="no effect: the result is always exact")
    c = commands.add_parser("convert", help="write a panel file from CSV, Parquet or pickle")
    c.add_argument("input")
    c.add_argument("output")
    c.add_argument("--input-format", default="auto", choices=["auto", "csv", "parquet", "pickle"])
    c.add_argument("--y", required=True)
    c.add_argument("--x", type=names, required=True)
    c.add_argument("--fe", type=names, required=True)
    c.add_argument("--iv", type=names, default=())
    c.add_argument("--cluster")
    c.add_argument("--weights")
    c.add_argument("--precision", default="float64", choices=["float64", "float32"])
    c.add_argument("--drop-missing", action="store_true")
    c.add_argument("--summary", action="store_true")
    s = commands.add_parser("synthesize", help="generate a worker-firm panel")
    for name, kind in PanelOptions.__annotations__.items():
        flag = "--" + name.replace("_", "-")
        if kind.startswith("tuple"):
            s.add_argument(flag, type=float if "float" in kind else int, nargs="*", default=None)
        else:
            s.add_argument(flag, type={"int": int, "float": float}[kind], default=None)
    s.add_argument("--precision", default="float64", choices=["float64", "float32"])
    s.add_argument("-o", "--output", default="synthetic_data.bin")
    s.add_argument("--parquet-output")
    return top


def estimate(spark: SparkSession, config: RunConfig):
    """Fit what a configuration asks for; without a formula, all roles of the panel file."""
    try:
        kind = guess_format(config.data)
    except ValueError:  # not a table's suffix: a panel file
        kind = None
    if kind:
        df, spec = read_table(spark, config.data, kind), None
    else:
        df, spec = read_panel(spark, config.data)
        if config.fe_names:
            new = rename_fe(spec.fe, config.fe_names)
            df, spec = df.withColumnsRenamed(new), ModelSpec(spec.y, spec.x, spec.z, tuple(new.values()), spec.cluster, spec.weights)
    if config.formula:
        formula = parse(config.formula)
    elif spec:
        formula = Formula(spec.y, tuple(Factor(x) for x in spec.x))
    else:
        raise ValueError("a table needs a formula")
    if spec and spec.y.lower() != formula.y.lower():
        log.info("the dependent variable of the file is %s", spec.y)
    regressors = tuple(t.name for t in formula.terms)
    fe = formula.fe if formula.fe is not None else (spec.fe if spec else ())
    changes = {}
    if config.iv_cols:
        changes["endogenous"] = tuple(Factor(x) for x in by_position(regressors, config.iv_cols, "regressors"))
        if not formula.instruments and spec:
            chosen = by_position(spec.z, config.iv_z_cols, "instruments") or spec.z
            changes["instruments"] = tuple(Factor(z) for z in chosen)
    if config.cluster_fe:
        changes["cluster"] = by_position(tuple(fe), config.cluster_fe, "cluster dimensions")
    formula = Formula(**{**formula.__dict__, **changes})
    result = fit(df, formula, spec, FitOptions(config.fe_tol, config.fe_max_iters), effects=bool(config.save_fe))
    if config.save_fe:
        write_csv(result.effects, config.save_fe)
    return result


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.addLevelName(TRACE, "TRACE")
    logging.basicConfig(level=TRACE if args.log_level == "TRACE" else args.log_level, stream=sys.stderr)
    spark = SparkSession.builder.appName("lattica").getOrCreate()
    if args.command == "estimate":
        config = load_config(args.config) if args.config else RunConfig()
        for key in RunConfig.__annotations__:
            value = getattr(args, key, None)
            if value is not None and value is not False:  # 0 is a value
                setattr(config, key, value)
        print(estimate(spark, config).summary())
    elif args.command == "convert":
        spec = ModelSpec(args.y, args.x, args.iv, args.fe, args.cluster, args.weights)
        df = read_table(spark, args.input, args.input_format, spec.columns())
        info = write_panel(df, args.output, spec, args.precision, args.drop_missing)
        if args.summary:
            print(summary_json(info))
    else:
        given = {k: v for k in PanelOptions.__annotations__ if (v := getattr(args, k)) is not None}
        options = PanelOptions(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})
        panel = build_panel(spark, options)
        extras = tuple(c for c in panel.columns if c.startswith("extra_"))
        spec = ModelSpec("wage", ("tenure", "sick_shock", *extras), tuple(c for c in panel.columns if c.startswith("iv_")), ("worker", "firm", "time"))
        write_panel(panel, args.output, spec, args.precision)
        if args.parquet_output:
            write_parquet(panel, args.parquet_output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
