"""Command line of the whole run: ``spark-submit helmwind/plans/cli.py --input FILE``."""

from __future__ import annotations

import argparse
import warnings

from pyspark.sql import SparkSession

from helmwind.plans import plots
from helmwind.plans.pipeline import run_pipeline
from helmwind.sources.headers import RF_UNITS


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Regimes of a price series, strategies on them, and their metrics.")
    add = p.add_argument
    add("--input", required=True)
    add("--sheet")
    add("--date-col")
    add("--close-col")
    add("--rf-col")
    add("--rf-unit", choices=RF_UNITS, default="annual_percent")
    add("--trading-days", type=int, default=252)
    add("--start-date")
    add("--end-date")
    add("--feature-set", choices=("paper", "example", "extra"), default="paper")
    add("--log-dd", action="store_true")
    add("--warmup", type=int, default=252)
    add("--extra-feature", action="append", default=[], help="column[:transform[:parameter]]; may be repeated")
    add("--extra-file")
    add("--extra-sheet")
    add("--extra-date-col")
    add("--model", choices=("jm", "sjm"), default="jm")
    add("--max-feats", type=float)
    add("--pin-feature", action="append", default=[])
    add("--jump-penalty", type=float, default=50.0)
    add("--window", type=int, default=3000)
    add("--min-window", type=int, default=500)
    add("--n-components", type=int, default=2)
    add("--clip-mul", type=float, default=3.0)
    add("--n-init", type=int, default=10)
    add("--random-state", type=int, default=0)
    add("--refit-start")
    add("--hmm", action="store_true")
    add("--hmm-window", type=int)
    add("--hmm-refit-every", type=int, default=21)
    add("--hmm-smooth-k", type=int, default=6)
    add("--hmm-n-init", type=int, default=10)
    add("--hmm-covariance-type", default="diag")
    add("--hmm-simple-ret", action="store_true")
    add("--delay", type=int, default=1)
    add("--cost-bps", type=float, default=10.0)
    add("--buy-cost-bps", type=float)
    add("--sell-cost-bps", type=float)
    add("--max-cash", type=float, default=1.0)
    add("--min-cash", type=float, default=0.0)
    add("--delays", default="1,5,10")
    add("--no-robustness", action="store_true")
    add("--outdir", default="out")
    add("--no-plot", action="store_true")
    add("--plot-font", help="font family of the figures")
    add("--save-features", action="store_true")
    add("--quiet", action="store_true")
    return p


def main(argv: list[str] | None = None) -> dict:
    options = vars(build_parser().parse_args(argv))
    quiet = options.pop("quiet")
    plot, font = not options.pop("no_plot"), options.pop("plot_font")
    warnings.simplefilter("ignore" if quiet else "always", UserWarning)
    options["robustness"] = not options.pop("no_robustness")
    options["pin_features"] = options.pop("pin_feature")
    options["extra_features"] = options.pop("extra_feature")
    spark = SparkSession.builder.appName("helmwind").getOrCreate()
    tables = run_pipeline(spark, options.pop("input"), **options)
    if plot and plots.plt is not None:
        if font:
            plots.plt.rcParams["font.family"] = font
        names = [c.removeprefix("center_") for c in tables["refit_params"].columns if c.startswith("center_")]
        plots.draw(tables, names, options["outdir"], options["trading_days"])
    if not quiet:
        tables["performance"].show(50, truncate=False)
        if "feature_selection" in tables:
            tables["feature_selection"].show(50, truncate=False)
    return tables


if __name__ == "__main__":
    main()
